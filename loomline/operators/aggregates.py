"""Aggregates: quantiles by three rules, shares, entropy, duplicate groups, counters."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import once


def linear_percentile(col: str, p: float) -> Column:
    """Between neighbours, by position p (n - 1)."""
    return F.percentile(col, p)


def value_ranks(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, v, lo, hi, m): rows lo + 1 to hi of a group's m sorted rows hold v. Equal values are counted before anything is sorted."""
    w = Window.partitionBy(key)
    c = df.where(F.col(col).isNotNull()).groupBy(key, F.col(col).alias("v")).agg(F.count("*").alias("c"))
    hi = F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return c.select(key, "v", (hi - F.col("c")).alias("lo"), hi.alias("hi"), F.sum("c").over(w).alias("m"))


def at_rank(rank: Column) -> Column:
    """An aggregate over value_ranks: the value of the row of that rank, from 1."""
    return F.max(F.when((F.col("lo") < rank) & (rank <= F.col("hi")), F.col("v")))


def nearest_rank(df: DataFrame, key: str, col: str, named: dict[str, float]) -> DataFrame:
    """The value at index min(n - 1, floor(p n)) of each group's sorted values; nothing is collected."""
    at = lambda p: F.least(F.col("m"), F.floor(F.lit(p) * F.col("m")) + 1)
    return value_ranks(df, key, col).groupBy(key).agg(*[at_rank(at(p)).alias(k) for k, p in named.items()])


def exclusive_quantiles(df: DataFrame, key: str, col: str, n: int) -> DataFrame:
    """(key, k, v): the n - 1 cut points at positions k (rows + 1) / n, between neighbours; groups of one row give none."""
    rank = lambda k: F.greatest(F.lit(1), F.least(F.col("m") - 1, F.floor(k * (F.col("m") + 1) / n)))
    cuts = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: F.struct(k.alias("k"), rank(k).alias("j")))
    near = F.filter(cuts, lambda s: (s["j"] + 1 > F.col("lo")) & (s["j"] <= F.col("hi")))
    rows = value_ranks(df, key, col).where("m > 1").select(key, "v", "lo", "hi", "m", F.explode(near).alias("s")).select(key, "v", "lo", "hi", "m", "s.*")
    found = rows.groupBy(key, "k").agg(at_rank(F.col("j")).alias("a"), at_rank(F.col("j") + 1).alias("b"), (F.max("k") * (F.max("m") + 1) - F.max("j") * n).alias("over"))
    return found.select(key, "k", ((F.col("a") * (n - F.col("over")) + F.col("b") * F.col("over")) / n).alias("v"))


def position_means(df: DataFrame, values: str, keys: list[str], edge: int = 250, width: int = 1000) -> DataFrame:
    """(keys..., part, mean, n, rows): the mean over a ragged array's first `edge` values, its last, those between (null where it has
    no more than 2 * edge), and each `width` from its start, averaged over the rows that have the part; n values in all.

    Each row is cut into its parts and summed before anything is exploded, so there is a row for each part, not for each value.
    """
    x, size = F.col(values), F.size(values)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
    part = lambda name, v: F.struct(name.alias("part"), total(v).alias("sum"), F.size(v).alias("n"))
    lit = lambda v: F.lit(v)
    ends = F.array(
        part(lit("first"), F.slice(x, 1, edge)), part(lit("last"), F.slice(x, F.greatest(size - edge + 1, lit(1)), edge)),
        part(lit("mid"), F.slice(x, edge + 1, F.greatest(size - 2 * edge, lit(0)))),
    )
    bins = F.transform(F.sequence(lit(0), F.greatest(size - 1, lit(0)), lit(width)), lambda a: part(F.concat(lit("from "), a.cast("string")), F.slice(x, a + 1, lit(width))))
    rows = df.where(size > 0).select(*keys, F.explode(F.concat(ends, bins)).alias("p")).select(*keys, "p.*").where("n > 0")
    return rows.groupBy(*keys, "part").agg(F.avg(F.col("sum") / F.col("n")).alias("mean"), F.sum("n").alias("n"), F.count("*").alias("rows"))


def side_by_side(frames: list[DataFrame]) -> DataFrame:
    """One-row frames as one row."""
    one = [f.withColumn("__one", F.lit(1)) for f in frames]
    return reduce(lambda a, b: a.join(b, "__one"), one).drop("__one")


def duplicate_groups(df: DataFrame, key: str, id_col: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("c"), F.min(id_col).alias("first_id")).where("c > 1")


def top_counts(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent keys; ties by key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def top_duplicates(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k largest groups of two or more, with how many rows all such groups cover."""
    groups = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return groups.orderBy(F.desc("n"), key).limit(k).crossJoin(F.broadcast(groups.agg(F.sum("n").alias("covered"))))  # one row beside k


def shares(df: DataFrame, key: str) -> DataFrame:
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).withColumn("p", F.col("n") / F.col("total"))  # one row beside each key


def entropy(df: DataFrame, key: str) -> DataFrame:
    return shares(df, key).agg((-F.sum(F.col("p") * F.log2("p"))).alias("bits"), F.count("*").alias("kinds"))


def top_shares(df: DataFrame, key: str, tops: tuple[int, ...]) -> DataFrame:
    """What part of all rows the most frequent keys have; only the top keys are ranked."""
    p = shares(df, key).orderBy(F.desc("n"), key).limit(max(tops))
    ranked = p.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(key).alias("key"), "p"))).alias("x"))
    return ranked.select(*[F.round(F.aggregate(F.slice("x", 1, k), F.lit(0.0), lambda s, y: s + y["p"]), 6).alias(f"top{k}") for k in tops])


def distinct_with_null(col: str) -> Column:
    """Distinct values, null being one."""
    return F.count_distinct(col) + F.max(F.col(col).isNull().cast("int"))


def long_counters(df: DataFrame, columns: dict[str, str], arrays: dict[str, str], seconds: str) -> DataFrame:
    """(key, n, hours) for kind:value of each column and of each array's elements; one pass over the rows."""
    mark = lambda k: lambda x: F.concat(F.lit(f"{k}:"), x)
    named = [F.array(mark(k)(F.col(c))) for k, c in columns.items()] + [F.transform(c, mark(k)) for k, c in arrays.items()]
    rows = df.select(F.explode(F.concat(*named)).alias("key"), F.col(seconds).alias("s"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.round(F.sum("s") / 3600.0, 6).alias("hours"))


def vocabulary(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, n, coverage): the k most frequent, with the part of all rows they cover so far."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), key).limit(k).crossJoin(F.broadcast(n.agg(F.sum("n").alias("t"))))  # one row beside k
    running = F.sum("n").over(Window.orderBy(F.desc("n"), key))  # over k rows
    return top.select(key, "n", F.round(running / F.col("t"), 6).alias("coverage"))


def preference_pairs(df: DataFrame, key: str, item: str, score: str, margin: float) -> DataFrame:
    """(key, loser, winner): the items of least and largest score, if margin apart; ties to the smaller item."""
    agg = df.groupBy(key).agg(F.min_by(item, F.struct(score, item)).alias("loser"), F.max_by(item, F.struct(F.col(score), -F.col(item))).alias("winner"), (F.max(score) - F.min(score)).alias("gap"))
    return agg.where(F.col("gap") >= margin).select(key, "loser", "winner")


def leave_one_out(df: DataFrame, key: str, col: str, out: str) -> DataFrame:
    """The mean of the group's other rows; null for a row alone."""
    w = Window.partitionBy(key)
    n = F.count("*").over(w) - 1
    return df.withColumn(out, F.when(n > 0, (F.sum(col).over(w) - F.col(col)) / n))


def micro_ratio(edits: str, n: str) -> Column:
    """Sum of edits over sum of n, one at least."""
    return F.sum(edits) / F.greatest(F.sum(n), F.lit(1))


def nan_mean(col: str) -> Column:
    return F.avg(F.when(~F.isnan(col), F.col(col)))


def nan_count(col: str) -> Column:
    return F.count(F.when(~F.isnan(col), F.col(col)))


def nan_median(col: str) -> Column:
    return F.median(F.when(~F.isnan(col), F.col(col)))


def mean_by_key(df: DataFrame, values: str) -> DataFrame:
    """(key, mean, n) of a map column's entries, whatever keys rows have; null and NaN values count for neither."""
    x = df.select(F.explode(values).alias("key", "value"))
    return x.groupBy("key").agg(nan_mean("value").alias("mean"), nan_count("value").alias("n"))


def paired_metrics(a: DataFrame, b: DataFrame, item: str, values: str) -> DataFrame:
    """(item, metric, a, b, state): metrics of two runs, maps from name to value, side by side; no list of names is needed.

    state: both, only_a, only_b where the other run has no such item or name; null where a value is null, nan where one
    is not a number. An item that a run has twice is an error of the caller (see unique_or_raise).
    """
    long = lambda x, name: x.select(item, F.explode(values).alias("metric", name)).withColumn(f"__{name}", F.lit(True))
    x = long(a, "a").join(long(b, "b"), [item, "metric"], "full")
    state = F.when(F.col("__b").isNull(), "only_a").when(F.col("__a").isNull(), "only_b").when(F.col("a").isNull() | F.col("b").isNull(), "null").when(F.isnan("a") | F.isnan("b"), "nan").otherwise("both")
    return x.select(item, "metric", "a", "b", state.alias("state"))


def paired_summary(pairs: DataFrame) -> DataFrame:
    """A row for each metric: pairs with both values, means, medians and the median difference over them, better and worse, and how many of each other state."""
    both = F.col("state") == "both"
    of = lambda v: F.when(both, v)
    d = F.col("b") - F.col("a")
    states = [F.count_if(F.col("state") == s).alias(s) for s in ("only_a", "only_b", "null", "nan")]
    return pairs.groupBy("metric").agg(F.count_if(both).alias("n"), F.avg(of(F.col("a"))).alias("mean_a"), F.avg(of(F.col("b"))).alias("mean_b"), F.median(of(F.col("a"))).alias("median_a"), F.median(of(F.col("b"))).alias("median_b"), F.median(of(d)).alias("median_diff"), F.count_if(both & (d < 0)).alias("better"), F.count_if(both & (d > 0)).alias("worse"), *states)


def metric_rows(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Long form: (key, metric, value); NaN is no value."""
    return df.unpivot([key], metrics, "metric", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))


#: Up to so many rows a cell's weight is an exact Poisson number, above a rounded normal one.
EXACT_COUNTS = 30


def poisson_steps(n: int) -> list[float]:
    """The distribution function of a Poisson number of mean n at 0, 1, ..., as far as 32 bits can tell."""
    out, p, total = [], math.exp(-n), 0.0
    for k in range(n * 3 + 30):
        total += p
        out.append(total)
        p *= n / (k + 1)
        if 1 - total < 2.0**-34:
            break
    return out


def bootstrap_cells(df: DataFrame, diff: str, step: float = 1e-6) -> DataFrame:
    """(cell, n): how many differences lie at each multiple of step; nulls and NaN are none."""
    return df.where(F.col(diff).isNotNull() & ~F.isnan(F.col(diff).cast("double"))).groupBy(F.bround(F.col(diff) / step).cast("long").alias("cell")).agg(F.count("*").alias("n"))


def bootstrap_draws(cells: DataFrame, draws: int, salt: str) -> DataFrame:
    """(draw, cell, w): how often each cell is drawn in each resample, by a hash of salt, cell and draw.

    A resample gives each row a Poisson(1) count, so a cell of n rows has a Poisson(n) one: draws cost cells, not rows.
    """
    spark = cells.sparkSession
    steps = F.broadcast(spark.createDataFrame([(n, poisson_steps(n)) for n in range(1, EXACT_COUNTS + 1)], "few int, steps array<double>"))  # 30 rows
    blocks = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 64)))  # dealt out, as few cells would be one task's
    x = cells.withColumn("block", blocks).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", "block")
    x = x.join(steps, F.col("few") == F.col("n"), "left").withColumn("draw", F.explode(F.sequence(F.col("block") * 64 + 1, F.least(F.lit(draws), F.col("block") * 64 + 64))))
    h = F.md5(F.concat_ws("|", F.lit(salt), F.col("cell").cast("string"), F.col("draw").cast("string")))
    u = lambda h, k: (F.conv(F.substring(h, k, 8), 16, 10).cast("long") + 0.5) / F.lit(4294967296.0)
    normal = lambda h: F.sqrt(-2 * F.ln(u(h, 1))) * F.cos(2 * math.pi * u(h, 9))
    many = lambda h: F.greatest(F.lit(0), F.round(F.col("n") + F.sqrt("n") * normal(h))).cast("long")
    exact = lambda v: F.size(F.filter("steps", lambda c: v >= c)).cast("long")
    return x.select("draw", "cell", once(h, lambda d: F.when(F.col("few").isNull(), many(d)).otherwise(once(u(d, 1), exact))).alias("w"))


def weighted_middles(rows: DataFrame, keys: list[str], cell: str, w: str) -> DataFrame:
    """(keys..., twice, total, sum): twice the weighted median of whole-number cells (the mean of the two middle ones), the weights and the weighted sum."""
    by = Window.partitionBy(*keys)
    upto = F.sum(w).over(by.orderBy(cell).rowsBetween(Window.unboundedPreceding, 0))
    x = rows.where(F.col(w) > 0).withColumn("__to", upto).withColumn("__all", F.sum(w).over(by))
    at = lambda pos: F.max(F.when((F.col("__to") >= pos) & (F.col("__to") - F.col(w) < pos), F.col(cell)))
    return x.groupBy(*keys).agg((at(F.floor((F.col("__all") + 1) / 2)) + at(F.floor(F.col("__all") / 2) + 1)).alias("twice"), F.max("__all").alias("total"), F.sum(F.col(cell) * F.col(w)).alias("sum"))


def bootstrap_intervals(df: DataFrame, diff: str, mean_draws: int = 4000, median_draws: int = 5000, step: float = 1e-6, salt: str = "b") -> DataFrame:
    """One row: n, mean, median, better (below 0), worse, and the 2.5 and 97.5 % points of resampled means and medians.

    Differences count as multiples of step. The median of a resample is the weighted one over its cells, so no resample is
    held and each is a window over cells. No rows give n 0 and nulls.
    """
    cells = bootstrap_cells(df, diff, step)
    drawn = weighted_middles(bootstrap_draws(cells, max(mean_draws, median_draws), salt), ["draw"], "cell", "w")
    mean, median = F.col("sum") * step / F.col("total"), F.col("twice") * step / 2
    point = lambda v, most, p: F.percentile(F.when(F.col("draw") <= most, v), p)
    ci = drawn.agg(point(mean, mean_draws, 0.025).alias("mean_low"), point(mean, mean_draws, 0.975).alias("mean_high"), point(median, median_draws, 0.025).alias("median_low"), point(median, median_draws, 0.975).alias("median_high"))
    whole = weighted_middles(cells.withColumn("one", F.lit(1)), ["one"], "cell", "n").select(F.col("total").alias("n"), (F.col("sum") * step / F.col("total")).alias("mean"), (F.col("twice") * step / 2).alias("median"))
    signs = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("cell") < 0, F.col("n"))), F.lit(0)).alias("better"), F.coalesce(F.sum(F.when(F.col("cell") > 0, F.col("n"))), F.lit(0)).alias("worse"))
    return side_by_side([signs.join(whole, "n", "left"), ci])


def level_usage(df: DataFrame, values: str, levels: list[int], edge: float = 0.98) -> DataFrame:
    """(dim, level, n, share, saturated): how often each level of each quantised axis is taken, its share, and the axis's part beyond edge.

    values: arrays with a number in (-1, 1) for each axis. Even numbers of levels lie half a step off.
    """
    v = df.select(F.posexplode(values).alias("dim", "v"))
    size = F.element_at(F.array(*map(F.lit, levels)), F.col("dim") + 1)
    half, off = (size - 1) / 2, F.when(size % 2 == 0, 0.5).otherwise(0.0)
    level = F.greatest(F.lit(0), F.least(size - 1, (F.bround(F.col("v") * half - off) + off + half).cast("int")))
    n = v.select("dim", level.alias("level"), (F.abs("v") > edge).cast("int").alias("s")).groupBy("dim", "level").agg(F.count("*").alias("n"), F.sum("s").alias("s"))
    w = Window.partitionBy("dim")
    return n.select("dim", "level", "n", (F.col("n") / F.sum("n").over(w)).alias("share"), (F.sum("s").over(w) / F.sum("n").over(w)).alias("saturated"))
