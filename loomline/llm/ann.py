"""Nearest neighbours by cosine over balanced posting lists.

Centroids come from k-means with splitting of large clusters, over a bounded sample. Every vector goes to the list of
its nearest centroid, and to lists nearly as near whose centroids lie in another direction (boundary vectors). A query finds centroids
by best-first search in a graph over them, and keeps the lists within a ratio of the nearest distance. Lists longer
than a limit are dealt out in parts, to each of which their queries go.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drawn, fit_in_one_task, written

SAME = 1e-9  # squared distance of unit vectors up to which two centroids, or a query and a centroid, count as equal


@dataclass
class Index:
    centroids: np.ndarray  # of unit length
    near: np.ndarray  # each centroid's neighbours in the graph
    entries: np.ndarray  # where a search starts

    def search(self, q: np.ndarray, want: int, beam: int) -> list[tuple[float, int]]:
        """The nearest centroids to a unit vector as (squared distance, centroid), by best-first search."""
        d = 2 - 2 * self.centroids[self.entries] @ q
        seen = set(self.entries.tolist())
        todo = list(zip(d.tolist(), self.entries.tolist(), strict=True))
        heapq.heapify(todo)
        best = [(-a, c) for a, c in todo]
        heapq.heapify(best)
        while todo:
            at, c = heapq.heappop(todo)
            if len(best) >= beam and at > -best[0][0]:
                break
            new = [x for x in self.near[c].tolist() if x not in seen]
            if not new:
                continue
            seen.update(new)
            for a, x in zip((2 - 2 * self.centroids[new] @ q).tolist(), new, strict=True):
                if len(best) < beam:
                    heapq.heappush(best, (-a, x))
                elif a < -best[0][0]:
                    heapq.heapreplace(best, (-a, x))
                else:
                    continue
                heapq.heappush(todo, (a, x))
        return sorted((-a, c) for a, c in best)[:want]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(-1, keepdims=True)  # so that no square under- or overflows
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


def fit(x: np.ndarray, lists: int, rounds: int = 10, degree: int = 24, seed: int = 1) -> Index:
    """Centroids over unit vectors; each round the smallest clusters' centroids move into those over twice the mean size."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(x)))
    c = x[rng.choice(len(x), lists, replace=False)]
    for turn in range(rounds):
        at = np.concatenate([(x[k : k + 8192] @ c.T).argmax(1) for k in range(0, len(x), 8192)])
        size = np.bincount(at, minlength=lists)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norm = np.sqrt((sums * sums).sum(1))
        c = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], c)
        if turn < rounds - 1:
            large = [k for k in np.argsort(-size) if size[k] > 2 * len(x) / lists]
            for big, small in zip(large, np.argsort(size), strict=False):
                if size[small] < len(x) / lists / 2:
                    c[small] = x[rng.choice(np.flatnonzero(at == big))]
    d = c @ c.T
    apart = np.ones(lists, bool)
    for a in range(lists):  # equal centroids would share a list's vectors out by chance and fill a search
        if apart[a]:
            apart[a + 1 :] &= 2 - 2 * d[a, a + 1 :] > SAME
    c, d, lists = c[apart], d[np.ix_(apart, apart)], int(apart.sum())
    near = np.argsort(-d, axis=1, kind="stable")[:, 1 : degree + 1]
    links = [set(r.tolist()) for r in near]
    for a in range(lists):  # both ways, and a ring, so that every centroid can be reached
        for b in near[a].tolist():
            links[b].add(a)
        links[a].add((a + 1) % lists)
    width = max(map(len, links), default=0)
    near = np.array([sorted(s) + [a] * (width - len(s)) for a, s in enumerate(links)]).reshape(lists, -1)
    return Index(c, near, np.unique(np.linspace(0, lists - 1, min(lists, 16)).astype(int)))


def usable(vector: str) -> Column:
    """Not null or empty, all components finite and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(x: pa.ChunkedArray | pa.Array) -> np.ndarray:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _nearest(top: int):
    """For each query of a list's part, the nearest of its vectors; scores are summed alike wherever a vector stands."""
    kind = pa.schema([("query_id", pa.int64()), ("qkey", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(queries: pa.Table, posted: pa.Table) -> pa.Table:
        if not queries.num_rows or not posted.num_rows:
            return kind.empty_table()
        raw_q, raw_v, ids = _matrix(queries["q"]).astype(np.float64), _matrix(posted["v"]).astype(np.float64), posted["vec_id"].to_numpy()
        own, v = queries["query_id"].to_numpy(), unit(raw_v)
        norm_v, out = np.sqrt((raw_v * raw_v).sum(1)), []
        for k in range(0, len(own), 256):
            s = unit(raw_q[k : k + 256]) @ v.T
            s[own[k : k + 256, None] == ids[None, :]] = -np.inf
            cut = np.partition(s, -top, axis=1)[:, -top] if s.shape[1] > top else np.full(len(s), -2.0)
            for r in range(len(s)):
                at = np.flatnonzero(s[r] >= max(cut[r] - 1e-9, -2.0))
                q = raw_q[k + r]
                score = (raw_v[at] * q).sum(1) / (norm_v[at] * np.sqrt((q * q).sum()))
                score = np.where(np.isfinite(score), score, s[r, at])
                for j in np.lexsort((ids[at], -score))[:top]:
                    out.append((k + r, at[j], score[j]))
        if not out:
            return kind.empty_table()
        row, at, score = (np.array(z) for z in zip(*out, strict=True))
        return pa.table([pa.array(own[row]), pa.array(queries["qkey"].to_numpy()[row]), pa.array(ids[at]), pa.array(score)], schema=kind)

    return run


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", bound: int = 30_000, most_lists: int = 8192,
    copies: int = 4, spread: float = 1.25, probes: int = 128, ratio: float = 2.0, part: int = 4000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest rows by cosine found for each query row, its own aside.

    Ties go to the smaller vec_id; fewer candidates than top give fewer rows. Rows without an id, and vectors that are null, empty,
    zero, hold null or non-finite components, or are of another length than most, take no part. Repeated rows count
    once; of equal vectors only the top + 1 smallest ids can be found, so the others are left out before lists are made
    (exactly: they could never be in a result). Centroids are fitted on about `bound` rows (documented limit), 2 sqrt(rows) of them, most_lists at
    most; the draw is among distinct vectors, so that a common one gets no more centroids than a rare one. Every row is indexed.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("is_query"))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == sizes["size"])
    n = sizes["count"]
    distinct = written(rows.groupBy("v").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "v"))
    sample = distinct.where(drawn(bound / distinct.count(), "ann", "vec_id"))
    index = fit_in_one_task(sample, lambda got: fit(unit(np.array([r[1] for r in got])), min(most_lists, int(2 * n**0.5) + 1)))
    if index is None:  # too few rows for the draw
        index = fit_in_one_task(distinct.orderBy("vec_id").limit(16), lambda got: fit(unit(np.array([r[1] for r in got])), 1))
    shared = spark.sparkContext.broadcast(index)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to its nearest centroid and to near ones no closer to one chosen before than to the vector."""
        c = shared.value.centroids
        for x in batches:
            if not x.num_rows:
                continue
            d = np.maximum(2 - 2 * unit(_matrix(x.column(1))) @ c.T, 0)
            m = min(copies, len(c))
            first = np.argpartition(d, m - 1, axis=1)[:, :m]
            first = np.take_along_axis(first, np.take_along_axis(d, first, 1).argsort(1, kind="stable"), 1)
            near = np.take_along_axis(d, first, 1)
            keep = near <= spread * near[:, :1] + 1e-12
            for b in range(1, m):
                for a in range(b):
                    keep[:, b] &= ~(keep[:, a] & (2 - 2 * (c[first[:, a]] * c[first[:, b]]).sum(1) < 0.5 * near[:, b]))
            row, col = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(first[row, col].astype(np.int32)), x.column(0).take(pa.array(row)), x.column(1).take(pa.array(row))], names=["list", "vec_id", "v"])

    kind = rows.schema["v"].dataType.simpleString()
    first_ids = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    kept = rows.select("vec_id", "v").withColumn("r", first_ids).where(F.col("r") <= top + 1).select("vec_id", "v").distinct()
    posted = written(kept.mapInArrow(post, f"list int, vec_id long, v {kind}"))
    parts = {r["list"]: -(-r["count"] // part) for r in posted.groupBy("list").count().collect()}  # at most most_lists rows
    shared_parts = spark.sparkContext.broadcast(parts)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query to every part of the lists that the search finds and the ratio keeps."""
        ix, n_parts = shared.value, shared_parts.value
        for x in batches:
            if not x.num_rows:
                continue
            to = []
            for r, q in enumerate(unit(_matrix(x.column(2)))):
                found = ix.search(q, probes, 2 * probes)
                least = next((d for d, _ in found if d > SAME), 0)  # a query may lie on a centroid: the next one tells how far others are
                to += [(r, c, p) for k, (d, c) in enumerate(found) if k < 16 or d <= ratio * least for p in range(n_parts.get(c, 0))]
            if to:
                row, lists, ps = (pa.array(np.array(z, np.int32)) for z in zip(*to, strict=True))
                yield pa.RecordBatch.from_arrays([lists, ps, *[x.column(k).take(row) for k in range(3)]], names=["list", "part", "query_id", "qkey", "q"])

    queries = rows.where("is_query").select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("qkey"), F.col("v").alias("q")).distinct()
    asked = queries.mapInArrow(ask, f"list int, part int, query_id long, qkey long, q {kind}")
    get = F.create_map(*[F.lit(z) for kv in sorted(parts.items()) if kv[1] > 1 for z in kv]) if any(p > 1 for p in parts.values()) else None
    n_part = F.coalesce(get[F.col("list")], F.lit(1)) if get is not None else F.lit(1)
    dealt = posted.withColumn("part", F.pmod(F.xxhash64("vec_id"), n_part).cast("int"))
    found = asked.groupBy("list", "part").cogroup(dealt.groupBy("list", "part")).applyInArrow(_nearest(top), "query_id long, qkey long, vec_id long, score double")
    found = found.groupBy("query_id", "qkey", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
