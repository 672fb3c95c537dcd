"""Crops of a timeline: the lines inside, masks of those cut at an edge, and the letters of those inside with their starts.

Crops and lines meet by bins of time, so each join is an equality on (song, bin).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import bins, interval_overlap

#: Starts are kept this far from the crop's end.
MARGIN = 1e-3


def contained(crops: DataFrame, lines: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs of crops(key, crop, c0, n) and lines(key, line, f0, f1, ...) that lie in them whole: c0 <= f0 and f1 <= c0 + n."""
    left = lines.withColumn("__b", F.floor(F.col("f0") / width))
    right = crops.withColumn("__b", F.explode(bins(F.col("c0"), F.col("c0") + F.col("n"), width)))
    return right.join(left, [key, "__b"]).where((F.col("f0") >= F.col("c0")) & (F.col("f1") <= F.col("c0") + F.col("n"))).drop("__b")


def until_first_overrun(pairs: DataFrame, key: str, end: str = "f1", slack: float = 0.3) -> DataFrame:
    """Of each crop's lines that start in it, in order, those before the first that ends later than slack behind the crop."""
    w = Window.partitionBy(key, "crop").orderBy("f0", "line").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.every(F.col(end) <= F.col("c0") + F.col("n") + slack).over(w)
    return pairs.withColumn("__w", whole).where("__w").drop("__w")


def starting_in(crops: DataFrame, lines: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs in which the line starts in the crop."""
    left = lines.withColumn("__b", F.floor(F.col("f0") / width))
    right = crops.withColumn("__b", F.explode(bins(F.col("c0"), F.col("c0") + F.col("n"), width)))
    return right.join(left, [key, "__b"]).where((F.col("f0") >= F.col("c0")) & (F.col("f0") < F.col("c0") + F.col("n"))).drop("__b")


def crop_rows(crops: DataFrame, lines: DataFrame, key: str, width: float) -> DataFrame:
    """(key, crop, line, k, at, until): the whole lines of each crop in order, in frames from its start."""
    w = Window.partitionBy(key, "crop").orderBy("f0", "line")
    x = contained(crops, lines, key, width).withColumn("k", F.row_number().over(w) - 1)
    return x.select(key, "crop", "line", "k", (F.col("f0") - F.col("c0")).alias("at"), (F.col("f1") - F.col("c0")).alias("until"))


def crop_masks(crops: DataFrame, lines: DataFrame, key: str, width: float) -> DataFrame:
    """(key, crop, a, b): runs of frames, a to b - 1 from the crop's start, that belong to lines cut at its edges; runs that meet are one."""
    spans = crops.select(key, "crop", "c0", "n", F.col("c0").alias("a0"), (F.col("c0") + F.col("n")).alias("a1"))
    met = interval_overlap(spans, lines.select(key, F.col("f0").alias("b0"), F.col("f1").alias("b1")), key, width)
    cut = met.where(~((F.col("b0") >= F.col("a0")) & (F.col("b1") <= F.col("a1"))))
    runs = cut.select(key, "crop", F.greatest(F.col("b0") - F.col("c0"), F.lit(0)).alias("a"), F.least(F.col("b1") - F.col("c0"), F.col("n")).alias("b")).where("b > a")
    w = Window.partitionBy(key, "crop").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = runs.withColumn("__o", F.when(reach.isNull() | (F.col("a") > reach), 1).otherwise(0))
    return opened.withColumn("__r", F.sum("__o").over(w)).groupBy(key, "crop", "__r").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("__r")


def kept_runs(crops: DataFrame, masks: DataFrame, key: str) -> DataFrame:
    """(key, crop, a, b): what the masks leave of each crop, also of crops without a mask."""
    w = Window.partitionBy(key, "crop").orderBy("a")
    edges = masks.select(key, "crop", "a", "b").unionByName(crops.select(key, "crop", F.col("n").alias("a"), F.col("n").alias("b")))
    return edges.select(key, "crop", F.coalesce(F.lag("b").over(w), F.lit(0)).alias("a"), F.col("a").alias("b")).where("b > a")


def crop_letters(crops: DataFrame, table: DataFrame, letters: DataFrame, key: str, width: float, blank: int = 1) -> DataFrame:
    """(key, crop, pos, letter, at): the letters of each crop's whole lines, a blank between lines, with starts from the crop's start.

    table(key, line, f0, f1, i0, i1) has each line's slice of its song's letters(key, ids, starts). A blank or a letter
    without a start has that of the next one that has, zero behind the last. Starts are clipped to the crop and never fall.
    """
    w = Window.partitionBy(key, "crop").orderBy("f0", "line")
    x = contained(crops, table, key, width).withColumn("k", F.row_number().over(w) - 1).join(letters, key)
    part = lambda c: F.slice(c, F.col("i0") + 1, F.col("i1") - F.col("i0"))
    own = F.arrays_zip(part("ids").alias("letter"), F.transform(part("starts"), lambda s: s - F.col("c0")).alias("s"))
    lead = F.when(F.col("k") > 0, F.array(F.struct(F.lit(blank).alias("letter"), F.lit(None).cast("double").alias("s")))).otherwise(F.array().cast("array<struct<letter:int,s:double>>"))
    rows = x.select(key, "crop", "n", "k", F.posexplode(F.concat(lead, own.cast("array<struct<letter:int,s:double>>"))).alias("i", "x")).select(key, "crop", "n", "k", "i", "x.*")
    v = Window.partitionBy(key, "crop").orderBy("k", "i")
    on, back = v.rowsBetween(0, Window.unboundedFollowing), v.rowsBetween(Window.unboundedPreceding, 0)
    timed = F.coalesce(F.first("s", ignorenulls=True).over(on), F.lit(0.0))
    clipped = F.greatest(F.lit(0.0), F.least(F.col("__s"), F.col("n") - MARGIN))
    return rows.withColumn("pos", F.row_number().over(v) - 1).withColumn("__s", timed).withColumn("__c", clipped).select(key, "crop", "pos", "letter", F.max("__c").over(back).alias("at"))
