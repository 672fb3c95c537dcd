"""Mixing sources to target weights by Poisson replication, and a global shuffle.

Every document of a source is repeated as often as a Poisson variable with the source's mean says; the variable is
the inverse of the distribution at a uniform number hashed from seed and doc_id, so any run gives the same corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions, without, written


def uniform(seed: int, *parts: Column) -> Column:
    """[0, 1): the first 13 hex digits of an md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, total: int | None = None, source_col: str = "source") -> DataFrame:
    """(source_key, n, rate): the mean number of times a document of each source is repeated.

    weights: the target share of each source (a source without one gets none). Without weights the target share is
    in proportion to the source's number of documents to `power`: 1 leaves shares as they are, 0 makes them equal.
    total: documents wanted; by default as many as there are. A null source is a source of its own.
    """
    n = docs.groupBy(source_key(source_col).alias("source_key")).agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        n = n.join(docs.sparkSession.createDataFrame([(f"={k}", float(v)) for k, v in weights.items()], "source_key string, w double"), "source_key", "left").fillna(0.0, ["w"])
    all_rows = n.agg(F.sum("n").alias("rows"), F.sum("w").alias("weight"))
    wanted = F.lit(float(total)) if total is not None else F.col("rows").cast("double")
    return n.crossJoin(F.broadcast(all_rows)).select("source_key", "n", F.when(F.col("weight") > 0, F.col("w") / F.col("weight") * wanted / F.col("n")).otherwise(F.lit(0.0)).alias("rate"))  # one row beside each source


def source_key(source_col: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))


def distributions(rate: DataFrame) -> DataFrame:
    """(source_key, cdf): cdf[k] is the chance of k or fewer; as far as twelve deviations and twenty beyond the mean."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    by = Window.partitionBy("source_key").orderBy("k")
    log = F.when(F.col("rate") > 0, -F.col("rate") + F.col("k") * F.log("rate") - F.sum(F.log(F.greatest("k", F.lit(1)).cast("double"))).over(by))
    terms = rate.select("source_key", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k")).select("source_key", "k", F.when(F.col("rate") > 0, F.exp(log)).otherwise((F.col("k") == 0).cast("double")).alias("p"))
    return terms.select("source_key", "k", F.sum("p").over(by).alias("c")).groupBy("source_key").agg(F.array_sort(F.collect_list("c")).alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, total: int | None = None, seed: int = 17) -> DataFrame:
    """docs repeated to the target weights, with replica (from 1), repeats and shuffle_key, in a global random order.

    Rows are dealt to partitions by a hash of shuffle_key and sorted by it within them. A row's number of repeats
    depends on its source's rate, the seed and its doc_id alone: repeated rows, and rows without an id, repeat alike.
    A document with 0 repeats is gone. A text is any value. An empty table gives none. Columns of the three
    names (case aside) are replaced; others pass through. The table of rates has a row a source and is joined as
    its size asks.
    """
    rest = without(docs, "replica", "repeats", "shuffle_key", "cdf", "source_key", "u")
    cdfs = written(distributions(rates(docs, weights, power, total)))
    u = uniform(seed, F.col("doc_id"))
    counted = rest.withColumn("source_key", source_key()).join(cdfs, "source_key").withColumn("u", u).withColumn("repeats", F.size(F.filter("cdf", lambda c: c <= F.col("u")))).where("repeats > 0")
    copies = counted.drop("cdf", "source_key", "u").withColumn("replica", F.explode_outer(F.sequence(F.lit(1), F.col("repeats"))))
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("replica").cast("string"))
    keyed = copies.withColumn("shuffle_key", F.substring(F.md5(text), 1, 16))
    return keyed.repartition(shuffle_partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key").select(*rest.columns, "replica", "repeats", "shuffle_key")


def oracle_sql(power: float = 0.5, seed: int = 17) -> str:
    return f"""
        WITH n AS (SELECT coalesce('=' || source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
        r AS (SELECT s, pow(CAST(n AS DOUBLE), {power}) / (SELECT sum(pow(CAST(n AS DOUBLE), {power})) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
        k AS (SELECT s, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM r),
        t AS (SELECT s, k, exp(-rate + k * ln(rate) - sum(ln(CAST(greatest(k, 1) AS DOUBLE))) OVER (PARTITION BY s ORDER BY k)) AS p FROM k),
        c AS (SELECT s, list(c) AS cdf FROM (SELECT s, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM t) GROUP BY s),
        u AS (SELECT *, CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
        d AS (SELECT u.*, len(list_filter(cdf, lambda x: x <= u.u)) AS repeats FROM u JOIN c ON c.s = coalesce('=' || u.source, '')),
        e AS (SELECT *, unnest(range(1, repeats + 1)) AS replica FROM d WHERE repeats > 0)
        SELECT doc_id, text, lang, source, n_chars, CAST(replica AS INTEGER) AS replica, CAST(repeats AS INTEGER) AS repeats,
               substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || CAST(replica AS VARCHAR)), 1, 16) AS shuffle_key
        FROM e"""
