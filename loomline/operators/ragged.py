"""Ragged arrays in shards: one stream of values a shard in chunks, offsets of its rows, slices that read only their chunks.

A shard's stream is never one row: chunks hold so many values at most, and a slice of row j touches the chunks between
its offsets alone, found by equality on (shard, chunk) or, for one row, by filters that reach Parquet's row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 1 << 16


def _sizes(values: str) -> Column:
    return F.greatest(F.size(F.coalesce(F.col(values), F.array())), F.lit(0)).cast("long")


def offsets(rows: DataFrame, values: str, shard: str = "shard", row: str = "j") -> DataFrame:
    """(shard, j, low, high): where each row's values lie in its shard's stream, rows in the order of j. Null arrays are empty."""
    high = F.sum("__n").over(Window.partitionBy(shard).orderBy(row))
    return rows.select(shard, row, _sizes(values).alias("__n")).select(shard, row, (high - F.col("__n")).alias("low"), high.alias("high"))


def chunked(rows: DataFrame, values: str, shard: str = "shard", row: str = "j", chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(shard, chunk, values) and (shard, j, low, high): the streams of all shards, cut every `chunk` values, and their offsets."""
    where = offsets(rows, values, shard, row)
    size, high = _sizes(values), F.sum("__n").over(Window.partitionBy(shard).orderBy(row))
    placed = rows.select(shard, row, F.col(values).alias("__v"), size.alias("__n")).select(shard, row, "__v", (high - F.col("__n")).alias("low"), high.alias("high")).where("high > low")  # values move with their window, no join brings them back
    parts = placed.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("low") / chunk), F.floor((F.col("high") - 1) / chunk))))
    first, last = F.greatest("low", F.col("chunk") * chunk), F.least("high", (F.col("chunk") + 1) * chunk)
    cut = F.slice("__v", (first - F.col("low") + 1).cast("int"), (last - first).cast("int"))
    held = parts.groupBy(shard, "chunk").agg(F.array_sort(F.collect_list(F.struct(first.alias("at"), cut.alias("v")))).alias("x"))  # of `chunk` values at most
    return held.select(shard, "chunk", F.flatten(F.transform("x", lambda s: s["v"])).alias("values")), where


def sliced(chunks: DataFrame, where: DataFrame, shard: str = "shard", row: str = "j", chunk: int = CHUNK, places: bool = False) -> DataFrame:
    """(shard, j, values) for the rows of where(shard, j, low, high), with low and high too if places; rows without values have an empty array."""
    kind = chunks.schema["values"].dataType
    wanted = where.where("high > low").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("low") / chunk), F.floor((F.col("high") - 1) / chunk))))
    first, last = F.greatest("low", F.col("chunk") * chunk), F.least("high", (F.col("chunk") + 1) * chunk)
    part = F.slice("values", (first - F.col("chunk") * chunk + 1).cast("int"), (last - first).cast("int"))
    names = [shard, row, "low", "high"] if places else [shard, row]
    got = wanted.join(chunks, [shard, "chunk"]).groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("chunk", part.alias("v")))).alias("x"))
    got = got.select(*names, F.flatten(F.transform("x", lambda s: s["v"])).alias("values"))
    return got.unionByName(where.where("high <= low").select(*names, F.array().cast(kind).alias("values")))


def write_ragged(rows: DataFrame, vectors: list[str], path: str, shard: str = "shard", row: str = "j", chunk: int = CHUNK) -> None:
    """path/<vector>/values and path/<vector>/offsets, dealt out and sorted by (shard, chunk), a row group for each few chunks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for v in vectors:
        chunks, where = chunked(rows, v, shard, row, chunk)
        chunks.repartitionByRange(n, shard, "chunk").sortWithinPartitions(shard, "chunk").write.option("parquet.block.size", 4 << 20).parquet(f"{path}/{v}/values")
        where.repartitionByRange(n, shard, row).sortWithinPartitions(shard, row).write.parquet(f"{path}/{v}/offsets")


def read_slice(spark: SparkSession, path: str, vector: str, shard: int, row: int, chunk: int = CHUNK) -> DataFrame:
    """(shard, j, values) of one row: its offsets by two pushed filters, its chunks by a pushed range."""
    where = spark.read.parquet(f"{path}/{vector}/offsets").where((F.col("shard") == shard) & (F.col("j") == row))
    at = where.first()
    chunks = spark.read.parquet(f"{path}/{vector}/values")
    low, high = (at["low"] // chunk, max(at["high"] - 1, at["low"]) // chunk) if at else (0, -1)
    return sliced(chunks.where((F.col("shard") == shard) & F.col("chunk").between(low, high)), where, chunk=chunk)


def word_count(ids: Column, blank: int) -> Column:
    """Runs of ids other than blank."""
    return F.size(F.filter(F.arrays_zip(ids.alias("a"), F.concat(F.array(F.lit(blank)), ids).alias("b")), lambda s: (s["a"] != blank) & (s["b"] == blank)))


def line_table(lines: DataFrame, key: str, order: str, frames: Column, rate: float = 25.0, blank: int = 1) -> DataFrame:
    """(key, order, f0, f1, f1c, i0, i1): the lines that a song's letters keep, with the slice of each in the song's ids.

    lines(key, order, f0, f1, ids). A line with ids and 0 <= f0 <= f1 lasts no longer than 2 seconds and a fifth for each
    id; it is kept if it then ends within the song's frames. Lines stand by their start. A line's words have one blank
    between them, and lines one blank between those that hold something.
    """
    ids = F.col("ids")
    x = lines.where((F.size("ids") > 0) & (F.col("f0") >= 0) & (F.col("f0") <= F.col("f1"))).withColumn("f1c", F.least(F.col("f1"), F.col("f0") + F.floor(rate * (2.0 + 0.2 * F.size("ids")))).cast("long"))
    letters = F.size(F.filter(ids, lambda v: v != blank))
    x = x.where(F.col("f1c") <= frames).withColumn("n", letters + F.greatest(word_count(ids, blank) - 1, F.lit(0)))
    w = Window.partitionBy(key).orderBy("f0", order)
    above = w.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("apart", F.coalesce(F.max((F.col("n") > 0).cast("int")).over(above), F.lit(0)))
    i0 = F.coalesce(F.sum("n").over(above), F.lit(0)) + F.sum("apart").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("i0", i0.cast("int")).select(key, order, "f0", F.least("f1", F.lit((1 << 31) - 1)).alias("f1"), "f1c", "i0", (F.col("i0") + F.col("n")).cast("int").alias("i1"))
