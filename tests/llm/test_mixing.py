"""Mixing: counts against a plain inverse of the Poisson distribution, and the defined odd cases."""

import hashlib
import math
from collections import Counter

from loomline.llm.mixing import mix_sources, rates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, repeats string, U string"


def plain(doc_id, rate, seed):
    u = int(hashlib.md5(f"{seed}|{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    k, p, c = 0, math.exp(-rate), math.exp(-rate)
    while u >= c and k < 10_000:
        k += 1
        p *= rate / k
        c += p
    return k


def rows():
    out = [(k, f"t{k}", "en", "hot" if k % 3 == 0 else f"s{k % 7}", 2) for k in range(900)]
    return out + [(900, None, "en", None, None), (901, "", None, None, 0), (None, "x", "en", "s1", 1), (None, "x", "en", "s1", 1), (5, "t5", "en", "s5", 2), (902, "rare", "en", "rare", 4)]


def test_counts_and_order(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "clash", "clash") for r in data], SCHEMA)
    got = mix_sources(df, seed=3).collect()
    n = Counter(r[3] for r in data)
    weight = sum(math.sqrt(v) for v in n.values())
    rate = {s: math.sqrt(v) / weight * len(data) / v for s, v in n.items()}
    want = Counter()
    for r in data:
        for k in range(1, plain(r[0], rate[r[3]], 3) + 1):
            want[(*r, k)] += 1
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars, r.replica) for r in got) == want
    assert 0.8 < len(got) / len(data) < 1.2
    parts = mix_sources(df, seed=3).rdd.glom().collect()
    assert all(p == sorted(p, key=lambda r: r.shuffle_key) for p in parts) and sum(bool(p) for p in parts) > 1


def test_weights_and_large_rates(spark):
    df = spark.createDataFrame([(k, "t", "en", "a" if k < 5 else "b", 1, "", "") for k in range(105)], SCHEMA)
    out = Counter(r.source for r in mix_sources(df, {"a": 1.0}, total=5000).collect())
    assert set(out) == {"a"} and 4500 < out["a"] < 5500  # each row about a thousand times: e**-1000 underflows
    assert mix_sources(df.limit(0)).collect() == [] and rates(df.limit(0)).collect() == []
