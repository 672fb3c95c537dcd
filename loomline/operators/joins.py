"""Joins: misses, leaks, membership, rings, intervals, nearest rows, clusters and survivors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: that with the largest order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def with_miss_flag(left: DataFrame, right: DataFrame, key: str, flag: str) -> DataFrame:
    return left.join(right.withColumn("__hit", F.lit(True)), key, "left").withColumn(flag, F.col("__hit").isNull()).drop("__hit")


def without_leaks(val: DataFrame, train: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """val rows whose key train lacks, and those it has; a null key matches nothing."""
    keys = train.where(F.col(key).isNotNull()).select(key).distinct()
    return val.join(keys, key, "left_anti"), val.join(keys, key, "left_semi")


def membership(df: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    return df.join(keys.select(key).distinct().withColumn("__in", F.lit(True)), key, "left").withColumn(flag, F.col("__in").isNotNull()).drop("__in")


def first_lines_key(lines: Column, norm, n: int = 12, least: int = 4) -> Column:
    """The first n normalised lines as one key; null below `least` lines."""
    return F.when(F.size(lines) >= least, F.array_join(F.slice(F.transform(lines, norm), 1, n), "\n"))


def ring(df: DataFrame, group: str, order: list[str], item: str, out: str) -> DataFrame:
    """Each row with the item of the next row of its group; the last with the first."""
    w = Window.partitionBy(group).orderBy(*order)
    first = F.first(item).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(out, F.coalesce(F.lead(item).over(w), first))


def rotated(arr: str, by: int = 1) -> Column:
    """The array with element i + by at i, round its end."""
    n = F.size(arr)
    return F.when(n == 0, F.col(arr)).otherwise(F.transform(arr, lambda x, i: F.get(F.col(arr), ((i + by) % n).cast("int"))))


def bins(lo: Column, hi: Column, width: float) -> Column:
    return F.sequence(F.floor(lo / width), F.floor(hi / width))


def interval_overlap(a: DataFrame, b: DataFrame, key: str, width: float, guard: float = 0.0) -> DataFrame:
    """Pairs of a (a0, a1) and b (b0, b1) of one key that overlap by more than guard; every pair once.

    Both sides are dealt into bins of `width`, so it is an equi-join; a pair is kept in the later of the bins in which its two start.
    """
    left = a.withColumn("__b", F.explode(bins(F.col("a0"), F.col("a1"), width)))
    right = b.withColumn("__b", F.explode(bins(F.col("b0"), F.col("b1"), width)))
    first = F.greatest(F.floor(F.col("a0") / width), F.floor(F.col("b0") / width))
    return left.join(right, [key, "__b"]).where((F.col("a0") + guard < F.col("b1")) & (F.col("a1") - guard > F.col("b0")) & (F.col("__b") == first)).drop("__b")


def point_in_interval(points: DataFrame, spans: DataFrame, key: str, at: str, width: float) -> DataFrame:
    """Points with the spans (b0 <= at < b1) they lie in, by bins."""
    left = points.withColumn("__b", F.floor(F.col(at) / width))
    right = spans.withColumn("__b", F.explode(bins(F.col("b0"), F.col("b1"), width)))
    return left.join(right, [key, "__b"]).where((F.col("b0") <= F.col(at)) & (F.col(at) < F.col("b1"))).drop("__b")


def nearest_within(left: DataFrame, right: DataFrame, key: str, at: str, other: str, tolerance: float, item: str, id_cols: list[str]) -> DataFrame:
    """Each left row with the item of the right row nearest in time, closer than tolerance (else null); ties to the earlier, then the smaller item.

    Bins of the tolerance: a right row goes to its bin and both neighbours.
    """
    l = left.withColumn("__b", F.floor(F.col(at) / tolerance))  # noqa: E741
    r = right.select(key, other, item).withColumn("__b", F.explode(F.array(*[F.floor(F.col(other) / tolerance) + k for k in (-1, 0, 1)])))
    gap = F.abs(F.col(at) - F.col(other))
    hits = l.join(r, [key, "__b"]).where(gap < tolerance).groupBy(*id_cols).agg(F.min_by(item, F.struct(gap, other, item)).alias(item), F.min(gap).alias("gap"))
    return left.join(hits, id_cols, "left")


def pairs_within(df: DataFrame, group: str, id_col: str, most: int = 40) -> DataFrame:
    """All pairs a < b within groups of 2 to `most` rows; the feature compares small groups only."""
    sized = df.withColumn("__n", F.count("*").over(Window.partitionBy(group))).where(F.col("__n").between(2, most)).drop("__n")
    return sized.alias("a").join(sized.alias("b"), (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{id_col}") < F.col(f"b.{id_col}")))


def single_link(df: DataFrame, groups: list[str], col: str, tie: str, gap: float) -> DataFrame:
    """cluster: rows of a group in order of col, a new cluster where the step is over gap."""
    w = Window.partitionBy(*groups).orderBy(col, tie)
    step = F.col(col) - F.lag(col).over(w)
    marked = df.withColumn("__new", F.when(step.isNull() | (step > gap), 1).otherwise(0))
    return marked.withColumn("cluster", F.sum("__new").over(w)).drop("__new")


def survivor(df: DataFrame, groups: list[str], order: list[Column], id_col: str) -> DataFrame:
    """dup_of: the id of the group's first row in order, null for that row."""
    first = F.first(id_col).over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("__f", first).withColumn("dup_of", F.when(F.col("__f") != F.col(id_col), F.col("__f"))).drop("__f")


def unmatched(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not done yet: the resume join."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """df as a table of that name, dealt into buckets by key and sorted in each: tables of as many buckets join on it as they lie."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def partition_wise(meta: DataFrame, arrays: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Two bucketed tables of one key, bucket by bucket: neither side is shuffled, so the arrays are read where they are used."""
    return meta.hint("merge").join(arrays, key, how)
