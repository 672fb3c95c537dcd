"""Language-model scores: counts and base against a plain version, the network's gradients and its gain on held-out texts."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomline.llm import gru
from loomline.llm.common import drawn
from loomline.llm.lm import lm_scores
from loomline.llm.queries import op3_lm

SCHEMA = "doc_id long, text string, word string, n long, learn string"


def words(text):
    return (text or "").encode().lower().split()


def test_counts_and_base(spark):
    rows = [(k, " ".join(f"W{(k * j) % 37}" for j in range(1, 3 + k % 50))) for k in range(300)] + [(300, None), (301, ""), (302, "unseen thing"), (None, "w1 w2"), (5, "w1 w1"), (5, "w1 w1"), (303, "w1\x0bW1 é " * 30_000)]
    df = spark.createDataFrame([(i, t, "x", 1, "x") for i, t in rows], SCHEMA)
    learn = F.coalesce(F.col("doc_id"), F.lit(0)) % 5 != 2
    c = Counter()
    for i, t in rows:
        if (i or 0) % 5 != 2:
            c.update([*words(t), b"\n"])
    n, v = sum(c.values()), len(c)
    want = sorted((i or -1, (i or 0) % 5 == 2, len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), b"\n"]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), b"\n"]), 4)) for i, t in rows)
    got = lm_scores(df, learn, head=20, lookup=25, sample=100).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    by = Counter((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got)
    assert by == Counter(w[1:] for w in want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_scores(df.limit(0), learn).collect() == []
    assert all(r.train_tokens == 0 for r in lm_scores(df.limit(3), F.lit(False)).collect())


def test_probabilities_sum_to_one():
    p = gru.init(np.array([9.0, 5, 4, 3, 2, 1]), 3.0, 4, 3)
    first = [math.exp(gru.score(p, [np.array([k])], 0)[0]) for k in range(7)]
    assert abs(sum(first) - 1) < 1e-4
    second = [math.exp(gru.score(p, [np.array([3, k])], 0)[0] - gru.score(p, [np.array([3])], 0)[0]) for k in range(7)]
    assert abs(sum(second) - 1) < 1e-4


def test_gradients():
    p = {k: v if k == "starts" else v.astype(float) for k, v in gru.init(np.array([9.0, 5, 4, 3, 2, 1]), 3.0, 4, 3).items()}
    texts = [np.array([1, 3, 6, 2, 0]), np.array([4, 0]), np.array([5, 5, 1, 2, 6, 0])]
    x, y, fresh, whose = gru.Lanes(texts, 2, 0).window(0, 20)
    kept, grad = [], {k: np.zeros_like(v) for k, v in p.items() if k != "starts"}
    out, _ = gru.forward(p, p["emb"] @ p["wx"] + p["b"], x, fresh, np.zeros((2, 4)), kept)
    on, flat = whose.ravel() >= 0, out.reshape(-1, 4)
    _, back = gru.output(p, flat[on].astype(float), y.ravel()[on], grad)
    dh = np.zeros(flat.shape)
    dh[on] = back
    gru.backward(p, x, fresh, kept, dh.reshape(out.shape), grad)
    for k in grad:
        at = tuple(np.random.default_rng(1).integers(0, s) for s in p[k].shape)
        up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        up[k][at] += 1e-3
        down[k][at] -= 1e-3
        assert abs(grad[k][at] - (gru.score(down, texts, 0).sum() - gru.score(up, texts, 0).sum()) / 2e-3) < 1e-4, k


def test_scores_do_not_depend_on_company():
    p = gru.init(np.arange(60, 0, -1.0), 9.0, 8, 6)
    rng = np.random.default_rng(2)
    texts = [np.append(rng.integers(0, 61, rng.integers(0, 90)), 0) for _ in range(70)]
    together = gru.score(p, texts, 0)
    assert np.allclose(together, [gru.score(p, [t], 0)[0] for t in texts], atol=1e-3)


def test_one_long_text_does_not_thin_out_the_windows(monkeypatch):
    """Work follows the tokens: windows are full in training, and in scoring those with few lanes are longer."""
    rng = np.random.default_rng(4)
    texts = [np.append(rng.integers(0, 61, n), 0) for n in [20_000, *[100] * 3000]]
    p, tokens = gru.init(np.arange(60, 0, -1.0), 9.0, 8, 6), sum(map(len, texts))
    trainer = gru.Trainer(p)
    trainer.learn(texts, 0)
    assert trainer.tokens == tokens and trainer.steps <= 2 * (tokens // (gru.WINDOW * gru.LANES) + 32)
    calls, output = [], gru.output
    monkeypatch.setattr(gru, "output", lambda *a: calls.append(len(a[2])) or output(*a))
    gru.score(p, texts, 0)
    assert sum(calls) == tokens and len(calls) <= 3 * (tokens // (gru.WINDOW * gru.LANES) + 1)
    x, y, first, there = gru.stream(texts, 7, 0)
    assert there.sum() == tokens and first.sum() == len(texts) and (x[first] == 0).all()
    assert (y.T.ravel()[:tokens] == np.concatenate(texts)).all()


def test_network_learns_from_rows_outside_the_first_sample(spark):
    """Only rows that the first sample leaves out hold a cycle of words: a held-out cycle is foreseen all the same, whatever the partitions are."""
    rng, n, sample = np.random.default_rng(3), 2000, 20
    ids = spark.range(n + 1).withColumnRenamed("id", "doc_id")
    picked = {r.doc_id for r in ids.where(drawn(sample / n, "lm")).collect()} - {n}
    assert 0 < len(picked) < 60
    cycle = " ".join("abcdefghij" * 20)
    rows = [(k, " ".join(rng.choice(list("abcdefghij"), 200)) if k in picked else cycle) for k in range(n)]
    df = spark.createDataFrame([*rows, (n, cycle)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scores(df, F.col("doc_id") < n, head=20, sample=sample, shard=200_000).collect()}
    assert got[n].held_out and got[n].score / got[n].n_tokens > got[n].base_score / got[n].n_tokens + 0.2
    again = {r.doc_id: r for r in lm_scores(df.repartition(3), F.col("doc_id") < n, head=20, sample=sample, shard=200_000).collect()}
    assert all(abs(again[k].score - got[k].score) < 1e-3 for k in got)


def test_held_out_gain(spark):
    got = op3_lm(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    held = [r for r in got if r.held_out]
    n = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / n > sum(r.base_score for r in held) / n + 0.05


def test_texts_are_split_once_for_training_and_scores(spark):
    """Three passes read the texts: counts, the first sample, and one that gives head ids to shards and scores alike."""
    n, read = 300, spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    df = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 41}" for j in range(1, 2 + k % 60))) for k in range(n)], "doc_id long, text string")
    df = df.withColumn("text", F.udf(seen, "string").asNondeterministic()("text"))
    assert lm_scores(df, F.col("doc_id") % 7 != 2, head=20, lookup=25, sample=50).count() == n
    assert read.value <= 3 * n
