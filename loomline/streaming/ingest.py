"""Incremental runs with Structured Streaming: each pass takes what is new, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_pass(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, condition: str = "true", keep: str = "30 days") -> None:
    """One pass: new JSON files under source, torn lines left out, rows that meet the condition, each key once, appended to target.

    A key is remembered for `keep` after it came, so the state is bounded by what comes in that time; a key that comes again
    later than that is a new one.
    """
    raw = spark.readStream.schema(f"{schema}, _corrupt_record string").json(source)
    rows = raw.where("_corrupt_record is null").drop("_corrupt_record").where(condition)
    once = rows.withColumn("__came", F.current_timestamp()).withWatermark("__came", keep).dropDuplicatesWithinWatermark([key]).drop("__came")
    once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def full_shards(df: DataFrame, index: str, size: int = 1000, flush: bool = False) -> DataFrame:
    """Rows of shards (index div size) that are full; with flush the last part too."""
    shard = F.floor(F.col(index) / size)
    n = df.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"))
    rows = df.withColumn("shard", shard)
    return rows if flush else rows.join(n.where(F.col("n") == size).select("shard"), "shard", "left_semi")


def shard_pass(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, index: str, size: int = 1000, flush: bool = False) -> None:
    """One pass of whole shards (index div size): what is new meets the rows of shards not full yet, and full ones are written.

    Each batch writes target/rows/batch=N and target/rest/batch=N, the rest being what later batches need of this one; so a
    batch reads its own files and the rest before it, not all that ever came. A batch that is done again overwrites what it
    has written. Shards are read with read_shards. With flush, parts of shards are written too, and what comes of them later adds to them.
    """

    def commit(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = [n for n in batches_at(spark, f"{target}/rest") if n < epoch]
        rows = batch.select(*spark.createDataFrame([], schema).columns)
        if before:
            rows = rows.unionByName(spark.read.schema(schema).parquet(f"{target}/rest/batch={max(before)}"))
        full = full_shards(rows, index, size, flush)
        full.write.mode("overwrite").parquet(f"{target}/rows/batch={epoch}")
        shard = F.floor(F.col(index) / size)
        left = rows.withColumn("shard", shard).join(spark.read.parquet(f"{target}/rows/batch={epoch}").select("shard").distinct(), "shard", "left_anti").drop("shard")
        left.write.mode("overwrite").parquet(f"{target}/rest/batch={epoch}")

    query = spark.readStream.schema(schema).json(source).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def batches_at(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that have written below a path, whole ones alone."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    whole = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(where) if whole(s.getPath()))


def read_shards(spark: SparkSession, target: str) -> DataFrame:
    """All rows of the shards that passes have written, with shard."""
    return spark.read.parquet(f"{target}/rows").drop("batch")
