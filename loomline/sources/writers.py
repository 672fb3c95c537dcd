"""Writers: JSON lines, views of one pass, packed shards, gates, checks and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fan_out(df: DataFrame, path: str, kinds: dict[str, Column], split: str) -> None:
    """One pass into path/kind=../split=..: a row goes to each kind whose condition holds."""
    rows = df.withColumn("kind", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))))
    rows.write.partitionBy("kind", split).json(path)


def slim(df: DataFrame, columns: list[str], order: str, first: int) -> tuple[DataFrame, DataFrame]:
    """The held-out first rows in order, and the others, of these columns; order is a dense number from 0."""
    return df.where(F.col(order) < first).select(*columns), df.where(F.col(order) >= first).select(*columns)


def gate(df: DataFrame, shard: str, error: str, most: float = 0.1) -> DataFrame:
    """Rows of shards in which no more than that part failed; the others are to be done again."""
    good = df.groupBy(shard).agg((F.count(error) / F.count("*")).alias("bad")).where(F.col("bad") <= most).select(shard)
    return df.join(good, shard, "left_semi").where(F.col(error).isNull())


def summary_json(df: DataFrame) -> DataFrame:
    """A one-row frame as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def digests(files: DataFrame) -> DataFrame:
    """(path, size, sha256) of binary files."""
    return files.select("path", F.length("content").alias("size"), F.sha2("content", 256).alias("sha256"))


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key is not at path yet. For one writer at a time: two that run together may both append a key."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    df.dropDuplicates([key]).write.mode("append").parquet(path)


def published(df: DataFrame, staging: str, live: str) -> None:
    """Write to staging, then put it in the place of live, which is moved aside and removed once the new one is there.

    If the driver ends between the two renames, the old one is found at live + ".old" and nothing at live; publish() in
    publish.py has no such moment.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(staging)
    a, b, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staging, live, f"{live.rstrip('/')}.old"))
    fs = b.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(b):
        if fs.exists(old):
            fs.delete(old, True)
        fs.rename(b, old)
    if not fs.rename(a, b):
        raise OSError(f"{staging} was not renamed to {live}")
    fs.delete(old, True)


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A table of a small summary."""
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(str(r.get(c, "")) for c in columns) + " |" for r in rows)]) + "\n"
