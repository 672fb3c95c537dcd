"""Token alignment against a plain version, and against its relational form."""

import hashlib
import json
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomline.llm.alignment import Tokenizers, alignment_report, common_groups, load_tokenizers, pair_counts, token_ends, token_links

SCHEMA = "doc_id long, text string, row long, pairs string, n_a string, best int"
TEXTS = [
    (1, "Hello world, the quick brown fox"), (2, None), (3, ""), (4, " "), (5, "a  b\n\nc\td "), (6, "naïve café 東京 🙂🙂 ﬁ"), (7, "has ▁ inside"), (8, "<s> <|endoftext|> <0x41>"), (9, "Hello world, the quick brown fox"),
    (9, "Hello world, the quick brown fox"), (None, "Hello there"), (11, "x\x00y"), (12, "internationalisation " * 4000), (13, " " * 25_000 + "z"), (14, "\x0b\x0c\r\n"), (15, "don't we'll 12345 67,8"), (16, "漢字かな" * 50),
]


def decoder():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain(rows):
    tok, sp, back = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), decoder()
    tok.encode_special_tokens = True
    names = {v: k for k, v in json.load(open(P.path("byte_bpe_50k.json")))["model"]["vocab"].items()}
    out, counts = [], Counter()
    for i, text in rows:
        a = tok.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        ba = [bytes(back[c] for c in names[x]) for x in a]
        bb = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in map(sp.id_to_piece, b)]
        if not text or b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            out.append((i, 0, 0, 0, Counter(), ""))
            continue

        def spans(tokens):
            at, found = 0, []
            for t in tokens:
                found.append((at, at + len(t)))
                at += len(t)
            return found

        sa, sb, links, groups, k, j = spans(ba), spans(bb), Counter(), [], 0, 0
        lo = 0
        for x, (s, e) in enumerate(sa):
            while sb[lo][1] <= s:
                lo += 1
            y = lo
            while y < len(sb) and sb[y][0] < e:
                links[a[x], b[y]] += 1
                y += 1
        for cut in sorted({e for _, e in sa} & {e for _, e in sb}):
            ga, gb = [], []
            while k < len(a) and sa[k][1] <= cut:
                ga.append(a[k])
                k += 1
            while j < len(b) and sb[j][1] <= cut:
                gb.append(b[j])
                j += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        counts.update(set(links))
        out.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(n, best.get(a, 0))
    return sorted(((i, n, m, g, sum(x.values()), sum(v for p, v in x.items() if counts[p] == best[p[0]]), sum(v * counts[p] for p, v in x.items()), d) for i, n, m, g, x, d in out), key=str)


@pytest.fixture(scope="module")
def spec(spark):
    return load_tokenizers(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("most_sent", [0, 10**6])
def test_report_by_brute_force(spark, spec, most_sent):
    docs = spark.createDataFrame([(i, t, 5, "clash", "clash", 1) for i, t in TEXTS], SCHEMA).repartition(4)
    found = alignment_report(docs, spec, most_sent)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == plain(TEXTS)
    assert alignment_report(docs.limit(0), spec).count() == 0


def test_documents_by_brute_force(spark, spec):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, alignment_report(docs, spec).collect()), key=str) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_relational_form_gives_the_same_links(spark, spec):
    tok, rows = Tokenizers(*spec.value[1:]), []
    texts = [(i, t) for i, t in TEXTS[:12] if i is not None and t][:8]
    for i, t in dict(texts).items():
        if ids := tok.encode(t):
            rows += [(i, s, p, int(x), int(tok.sizes[s][x])) for s in (0, 1) for p, x in enumerate(ids[s])]
    tokens = spark.createDataFrame(rows, "doc long, side int, pos int, id long, size long")
    a, b = common_groups(*[token_ends(tokens.where(f"side = {s}").drop("side")) for s in (0, 1)])
    links = token_links(a, b)
    plainly = {r[0]: r for r in plain(list(dict(texts).items())) if r[1]}
    assert {r[0]: r[1] for r in links.groupBy("doc").count().collect()} == {i: r[4] for i, r in plainly.items()}
    assert {r[0]: r[1] + 1 for r in a.groupBy("doc").agg(F.max("group")).collect()} == {i: r[3] for i, r in plainly.items()}
    pairs = links.select("doc", (F.col("a") * 32768 + F.col("b")).alias("c")).distinct().groupBy("doc").agg(F.collect_list(F.shiftleft("c", 32)).alias("pairs"))
    counted = {r[0]: r[1] for r in pair_counts(pairs).select("pair", "docs").collect()}
    assert sum(counted[r.a * 32768 + r.b] for r in links.collect()) == sum(r[6] for r in plainly.values())
