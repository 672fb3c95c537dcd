"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, frugal, written


class Forest:
    """Union-find over hashable nodes; the smaller root wins."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while (above := up.get(x, x)) != root:
            up[x], x = root, above
        return root

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if b < a:
                a, b = b, a
            self.up[b] = a
            self.up.setdefault(a, a)


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars around the smallest node; what is connected stays so."""
    forest = Forest()
    for x in batches:
        for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    yield from stars(forest)


def stars(forest: Forest) -> Iterator[pa.RecordBatch]:
    """(a, b) for every node b of a forest that has another root a."""
    nodes = [x for x in forest.up if forest.find(x) != x]
    for k in range(0, len(nodes), 65_536):
        part = nodes[k : k + 65_536]
        yield pa.RecordBatch.from_arrays([pa.array([forest.find(x) for x in part], pa.int64()), pa.array(part, pa.int64())], names=["a", "b"])


def _least(pairs: DataFrame, key: str, other: str) -> DataFrame:
    """pairs once each, with m, the least `other` of their key; rows are dealt by key and sorted once, a key's are never held together."""
    rows = Window.partitionBy(key).orderBy(other)
    found = pairs.select(key, other, F.first(other).over(rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("m"), F.lag(other).over(rows).alias("before"))
    return found.where(F.col("before").isNull() | (F.col("before") < F.col(other))).drop("before")


def connected_components(edges: DataFrame, most_rounds: int = 60, contracted: bool = False) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the component's smallest node.

    Each round is a large-star and a small-star step (linear in the edges, no pairs within a
    neighbourhood), each of which deals its edges out once; an edge that a round makes twice is one in the next, and rows never grow in number.
    It ends when every edge leads from a node to its root. Each round's edges are written to the shared folder, so that lineage doesn't grow and a lost executor costs one round.
    contracted: the tasks that made the edges have passed them through contract(). Null ends and loops are left out. An empty table gives an empty result.
    """
    e = edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a is not null and b is not null and a < b")
    e = written((e if contracted else e.mapInArrow(frugal(contract), "a long, b long")).distinct())
    before = None
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _least(both, "u", "v").where("v > u").select(F.least("u", "m").alias("a"), F.col("v").alias("b"))
        small = _least(large, "b", "a").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        old, e = e, written(small)
        drop_written(old)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select("a").distinct()
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(roots.select(F.col("a").alias("node"), F.col("a").alias("root")))
