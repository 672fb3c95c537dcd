"""Order and sampling by hashes: repeatable whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bucket_open


def hash_order(df: DataFrame, id_col: str, seed: str = "") -> DataFrame:
    """In the order of md5(seed id); with a seed a shuffle."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string"))), id_col)


def bernoulli(df: DataFrame, id_col: str, p: float, salt: str) -> DataFrame:
    return df.where(bucket_open(F.concat(F.col(id_col).cast("string"), F.lit(salt))) < p)


def stratified(df: DataFrame, stratum: str, id_col: str, n: int, parts: int = 64) -> DataFrame:
    """About n rows, each stratum in proportion and with one at least, by md5 of the id."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("__c"))
    quota = counts.crossJoin(F.broadcast(counts.agg(F.sum("__c").alias("__t")))).select(stratum, F.greatest(F.lit(1), F.bround(n * F.col("__c") / F.col("__t")).cast("long")).alias("__q"))
    order = [F.md5(F.col(id_col).cast("string")), F.col(id_col)]
    first = lambda x, *by: x.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r <= __q").drop("__r")
    dealt = df.join(quota, stratum).withColumn("__p", F.pmod(F.xxhash64(id_col), F.lit(parts)))
    return first(first(dealt, stratum, "__p"), stratum).drop("__p", "__q")  # a stratum's rows are cut in parts before they meet


def group_weights(df: DataFrame, bounds: dict[str, int]) -> DataFrame:
    """w: the least of 1 and bound over group size, for each grouping column."""
    for k, (c, _) in enumerate(bounds.items()):
        df = df.join(df.groupBy(c).agg(F.count("*").alias(f"__n{k}")), c, "left")
    parts = [b / F.col(f"__n{k}") for k, b in enumerate(bounds.values())]
    return df.withColumn("w", F.least(F.lit(1.0), *parts)).drop(*[f"__n{k}" for k in range(len(bounds))])


def weighted(df: DataFrame, group: str, id_col: str, weight: str, draws: int, salt: str = "w", bins: int = 1024) -> DataFrame:
    """(group, draw, id): in each group `draws` rows with replacement, by weight: a hash-uniform number in the running sum of weights.

    Numbers and rows meet by bins of the running sum, so a draw sees the rows of one bin, not those of its group.
    """
    w = Window.partitionBy(group).orderBy(id_col)
    total = F.sum(weight).over(Window.partitionBy(group))
    spans = df.select(group, id_col, (F.sum(weight).over(w) / total).alias("__hi"), ((F.sum(weight).over(w) - F.col(weight)) / total).alias("__lo"))
    wanted = df.select(group).distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    wanted = wanted.withColumn("__u", bucket_open(F.concat_ws("|", F.lit(salt), F.col(group).cast("string"), F.col("draw").cast("string"))))
    dealt = spans.where("__hi > __lo").withColumn("__b", F.explode(F.sequence(F.floor(F.col("__lo") * bins), F.floor(F.col("__hi") * bins))))
    return wanted.withColumn("__b", F.floor(F.col("__u") * bins)).join(dealt, [group, "__b"]).where("__lo <= __u and __u < __hi").select(group, "draw", id_col)


def magic_prime(slots: int) -> int:
    """The largest prime below slots that leaves 2 over 3."""
    n = slots - 1
    while n > 1 and not (n % 3 == 2 and all(n % d for d in range(2, int(n**0.5) + 1))):
        n -= 1
    return n


def window_offsets(spark, slots: int, count: int) -> DataFrame:
    """(i, at): quasi-random window numbers: (golden ratio times prime) i cubed, modulo the prime."""
    p = magic_prime(slots)
    step = int(p * ((5**0.5 - 1) / 2))
    i = F.col("id")
    cube = ((i * i) % p * i) % p
    return spark.range(count).select(i.alias("i"), ((cube * step) % p).alias("at"))
