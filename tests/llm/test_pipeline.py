"""The pipeline stage by stage over a whole table."""

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from loomline.llm.common import written

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups(sets, alike):
    """Brute force: what is linked by a Jaccard index of `alike` or more."""
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= alike * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    out = {}
    for k in sets:
        out.setdefault(find(k), set()).add(k)
    return list(out.values())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], SF)))
    before, clean, single, cut, mixed, encoded = kept
    assert all(k.columns == columns for k in kept[:-1])
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    gone = set(ids(before)) - set(ids(clean))
    assert len(gone & toxic) >= 0.6 * len(toxic) and len(gone - toxic) <= 0.15 * before.count()
    kept, sets = set(ids(single)), {r.doc_id: shingle_set(r.text) for r in clean.collect()}
    assert len(kept) == single.count() and kept <= set(sets)
    alike = groups(sets, 0.8)
    assert all(g & kept for g in alike) and len(kept) <= 1.01 * len(alike) and sum(len(g) > 1 for g in alike) > 3
    assert sorted(ids(cut)) == sorted(ids(single))
    text = {r.doc_id: r.text for r in single.collect()}
    for r in cut.collect():
        assert r.n_chars == len(r.text) and (r.text == text[r.doc_id] or len(r.text) < len(text[r.doc_id]))
    assert set(ids(mixed)) <= set(ids(cut)) and 0.7 < mixed.count() / cut.count() < 1.3
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = encoded.collect()
    assert Counter(r.doc_id for r in got) == Counter(ids(mixed))
    assert all(r.ids == library.encode(r.text, add_special_tokens=False).ids for r in got)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
