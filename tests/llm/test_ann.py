"""Nearest neighbours against brute force."""

import numpy as np
import pyarrow as pa

from loomline.llm.ann import fit, nearest_neighbours, unit
from loomline.llm.queries import op5_ann

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, q string"


def brute(rows, queries, top=5):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 4}
    out = {}
    for i, v in good:
        if i in queries:
            a = np.array(v, float)
            near = sorted((-round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 12), j) for j, b in ((j, np.array(w, float)) for j, w in good) if j != i)
            out[i] = [(j, -s) for s, j in near[:top]]
    return out


def test_recall_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, ids = unit(np.array([r.embedding for r in rows])), np.array([r.vec_id for r in rows])
    got = {}
    for r in op5_ann(spark, sf).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = 0
    for k in np.flatnonzero(ids % 50 == 0):
        s = x @ x[k]
        s[k] = -9
        best = np.lexsort((ids, -s))[:5]
        mine = got[ids[k]]
        assert sorted(mine) == [1, 2, 3, 4, 5] and all(mine[j][1] >= mine[j + 1][1] for j in range(1, 5))
        hits += len({v for v, _ in mine.values()} & set(ids[best].tolist()))
        assert all(abs(v - x[k] @ x[ids.tolist().index(i)]) < 1e-9 for i, v in mine.values())
    assert hits / 5 / sum(ids % 50 == 0) >= 0.9


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(v) for v in np.float32(rng.normal(size=4))]) for k in range(200)]
    rows += [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(300, 340)]  # one very common vector
    rows += [(350, [2.0, 4.0, 6.0, 8.0]), (351, None), (352, []), (353, [0.0] * 4), (354, [1.0, None, 1.0, 1.0]), (355, [float("nan"), 1.0, 1.0, 1.0]), (356, [float("inf"), 1.0, 1.0, 1.0]), (357, [1.0] * 5), (None, [1.0] * 4), rows[0], rows[0]]
    df = spark.createDataFrame([(i, v, 1, "clash", "clash") for i, v in rows], SCHEMA)
    got = {}
    for r in nearest_neighbours(df, df.vec_id % 50 == 0, probes=1000, ratio=1e9, copies=2, part=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, {k for k in range(0, 400, 50)})
    assert got.keys() == want.keys()
    for i in want:
        assert [(j, round(s, 9)) for _, j, s in sorted(got[i])] == [(j, round(s, 9)) for j, s in want[i]], i


def test_few_rows(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (51, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in nearest_neighbours(df, df.vec_id % 50 == 0).collect()] == [(50, 1, 51)]
    assert nearest_neighbours(df.limit(0), df.vec_id % 50 == 0).collect() == []


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(0)
    x = unit(rng.normal(size=(3000, 16)))
    index = fit(x, 200)
    hits = 0
    for q in x[:50]:
        true = set(np.argsort(-(index.centroids @ q))[:10].tolist())
        hits += len({c for _, c in index.search(q, 10, 40)} & true)
    assert hits / 500 > 0.95


def test_recall_with_a_third_of_equal_vectors(spark):
    rng = np.random.default_rng(5)
    n, dim = 102_000, 64
    x = np.float32(rng.normal(size=(n, dim)))
    hot = x[0].copy()
    x[::3] = hot
    centres = np.float32(rng.normal(size=(400, dim)))
    x[2::3] = centres[rng.integers(0, 400, len(x[2::3]))] + np.float32(0.5) * x[2::3]
    x[1::100] = hot + np.float32(np.repeat(0.3 * rng.normal(size=(n // 600, dim)), 6, 0) + 0.05 * rng.normal(size=(n // 100, dim)))  # sixes near the common vector
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), dim).cast(pa.list_(pa.float32()))}))
    is_query = (df.vec_id % 600).isin(0, 1, 302)
    got = {}
    for r in nearest_neighbours(df, is_query).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u, recall = unit(x), {0: [], 1: [], 302: []}
    for k in np.flatnonzero(np.isin(np.arange(n) % 600, (0, 1, 302))).tolist():
        s = np.round(u @ u[k], 9)
        s[k] = -9
        best = np.lexsort((np.arange(n), -s))[:5]
        recall[k % 600].append(len(got.get(k, set()) & set(best.tolist())) / 5)
    recall = {k: float(np.mean(v)) for k, v in recall.items()}
    assert min(recall.values()) >= 0.9, recall


def test_no_two_centroids_are_equal():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9000, 16))
    x[::3] = x[0]
    index = fit(unit(x), 300)
    c = index.centroids
    assert (c @ c.T - 2 * np.eye(len(c))).max() < 1 - 1e-10 and len(index.near) == len(c) and index.near.max() < len(c)
    found = [k for _, k in index.search(unit(x[0]), 40, 80)]
    assert len(set(found) & set(np.argsort(-(c @ unit(x[0])))[:40].tolist())) >= 36
