"""Closed syncmers against a plain version."""

import hashlib
import random
import re
import struct

import xxhash

from loomline.llm.queries import op10_syncmers
from loomline.llm.syncmers import KEEP, anchors, edit_fingerprints, with_next

SCHEMA = "doc_id long, text string, lang string, next string, sketch string"


def signed(x):
    return x - 2**64 if x >> 63 else x


def chain(values):
    """Spark's xxhash64 over several longs: each value's digest seeds the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=seed)
    return signed(seed)


def plain_anchors(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if w]
    h = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in words]
    pairs = [chain((a, b)) for a, b in zip(h, h[1:])]
    out = []
    for i in range(len(words) - 8):
        window = pairs[i : i + 8]
        if min(window) in (window[0], window[-1]):
            out.append((i, (chain([window[k] for k in (0, 2, 4, 6, 7)]) & (2**64 - 1)) >> 32))
    return out


def plain_sketch(text):
    got = sorted({a for _, a in plain_anchors(text)})
    return got[:KEEP] or [xxhash.xxh64_intdigest((text or "").encode(), seed=42) >> 32]


def plain_likeness(a, b):
    both = sorted({*a, *b})[:KEEP]
    return len([x for x in both if x in a and x in b]) / len(both)


def corpus():
    rng = random.Random(4)
    vocab = ["wort", "été", "The", "a", "b'c", "dog.", "x"] + [f"w{k}" for k in range(60)]
    rows = [(k, rng.choice([" ", "\n", "  "]).join(rng.choices(vocab, k=rng.randint(0, 120)))) for k in range(0, 160, 2)]
    rows += [(1, None), (3, ""), (5, " \t "), (7, "😀" * 9), (9, "one two"), (9, "one two three"), (11, "long " + "word soup here " * 4000), (None, "no id " * 12), (-4, rows[3][1])]
    return rows


def test_against_plain_version(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", "clash", "clash") for i, t in rows], SCHEMA)
    got = edit_fingerprints(df).collect()
    ordered = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    want = []
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = plain_sketch(t), plain_sketch(edited), plain_sketch(after)
        show = lambda s: "".join(f"{x:08x}" for x in s)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    assert sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got), key=str) == sorted(want, key=str)
    assert sorted((r.doc_id or 0, r.position, r.anchor) for r in anchors(df).collect()) == sorted((i or 0, p, a) for i, t in rows for p, a in plain_anchors(t))


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(3, "abcd")], "doc_id long, text string")
    (r,) = edit_fingerprints(one).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0
    assert edit_fingerprints(one.limit(0)).collect() == []


def test_next_for_any_number_of_ranges(spark):
    ids = random.Random(1).sample(range(-500, 500), 90)
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, t string")
    down = sorted(ids, reverse=True)
    want = dict(zip(down, down[1:] + down[:1]))
    for n in (1, 2, 7, 200):
        assert {r.doc_id: int(r.next.t) for r in with_next(df, "doc_id", ["t"], n).collect()} == want


def test_query_reads_whole_table_in_plan_without_python(spark):
    out = op10_syncmers(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    rows = out.collect()
    assert len(rows) == 200 and sum(r.near_edited for r in rows) > 5 * sum(r.near_next for r in rows)
