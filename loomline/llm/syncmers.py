"""Document fingerprints from closed syncmers over words, in DataFrame functions only.

A k-mer is nine words. It is chosen if, of its eight word pairs, the one with the least hash is the first or the
last. Whether a k-mer is chosen depends on its own words alone, so equal passages have equal anchors wherever they
stand. A fingerprint is the least KEEP anchor values of a text; the likeness of two is the share of the least KEEP
values of both together that each has (the Jaccard index of the anchor sets, exact up to KEEP anchors).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions

PAIRS = 8  # word pairs of a k-mer
KEEP = 48  # anchor values in a fingerprint


def _shift(x: Column, by: int, length: Column) -> Column:
    return F.slice(x, by + 1, F.greatest(length, F.lit(0)))


def with_anchors(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with out array<long>: for each k-mer of the text in order, its value (32 bits) if it is chosen, else null.

    Column by column, so that no step is computed twice.
    """
    w, p, a, b, c = (f"__{out}_{k}" for k in "wpabc")
    n = lambda col, less: F.size(col) - less
    least = lambda x, y: F.least(x, y)
    df = df.withColumn(w, F.transform(F.array_remove(F.split(F.lower(text_col), "[\\x20\\x09-\\x0D]+"), ""), lambda t: F.xxhash64(t)))
    df = df.withColumn(p, F.zip_with(_shift(F.col(w), 0, n(w, 1)), _shift(F.col(w), 1, n(w, 1)), lambda x, y: F.xxhash64(x, y)))
    df = df.withColumn(a, F.zip_with(_shift(F.col(p), 0, n(p, 1)), _shift(F.col(p), 1, n(p, 1)), least))
    df = df.withColumn(b, F.zip_with(_shift(F.col(a), 0, n(a, 2)), _shift(F.col(a), 2, n(a, 2)), least))
    df = df.withColumn(c, F.zip_with(_shift(F.col(b), 0, n(b, 4)), _shift(F.col(b), 4, n(b, 4)), least))
    at = lambda i: F.get(F.col(p), i)
    value = lambda i: F.shiftrightunsigned(F.xxhash64(at(i), at(i + 2), at(i + 4), at(i + 6), at(i + 7)), 32)
    return df.withColumn(out, F.transform(c, lambda x, i: F.when((x == at(i)) | (x == at(i + PAIRS - 1)), value(i)))).drop(w, p, a, b, c)


def with_sketch(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with out array<long>: the text's fingerprint; a text without an anchor (few words) has the value of the whole text alone."""
    df = with_anchors(df, text_col, out).withColumn(out, F.array_sort(F.array_distinct(F.array_compact(out))))
    whole = F.array(F.shiftrightunsigned(F.xxhash64(text_col), 32))
    return df.withColumn(out, F.when(F.size(out) > 0, F.slice(out, 1, KEEP)).otherwise(whole))


def likeness(a: str, b: str) -> Column:
    """0 to 1; 1 for equal fingerprints."""
    both = F.slice(F.array_sort(F.array_union(a, b)), 1, KEEP)
    return F.size(F.array_intersect(F.array_intersect(both, F.col(a)), F.col(b))) / F.size(both)


def printed(sketch: str) -> Column:
    """Eight hex digits a value."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, position, anchor): the chosen k-mers of each whole text by the position of their first word.

    Joined on anchor, two corpora match by position. Null and short texts have none; repeated rows repeat theirs.
    """
    # outer, so that no filter on the array is pushed below and makes every step anew
    rows = with_anchors(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "text", "anchors")
    return rows.select("doc_id", F.posexplode_outer("anchors").alias("position", "anchor")).where("anchor is not null")


def with_next(df: DataFrame, key: str, carry: list[str], buckets: int | None = None) -> DataFrame:
    """df with next struct<carry...>: those columns of the row with the next smaller key; after the last row, of the first.

    Rows of one key, or of none (these come last), follow each other by the carried values. No task sorts everything:
    keys are dealt into ranges at quantiles; each range also gets the first row of the range below it (the lowest that
    of the highest), so one shuffle moves each row once. The driver holds one key a range.
    """
    spark = df.sparkSession
    n = buckets or 4 * shuffle_partitions(spark)
    low = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    found = df.select(low.alias("k")).agg(F.percentile_approx("k", [i / n for i in range(1, n)] if n > 1 else [0.5], 20_000)).first()[0]
    bounds = sorted(set(found or [0]))
    step = max(1, int(len(bounds) ** 0.5))
    array = lambda x: F.lit(x).cast("array<bigint>") if x else F.array().cast("array<bigint>")
    below = lambda x: F.size(F.filter(x, lambda b: b <= F.col("__k")))
    coarse = below(array(bounds[::step]))
    fine = F.when(F.col("__c") > 0, (F.col("__c") - 1) * step + below(F.slice(array(bounds), (F.greatest(F.col("__c"), F.lit(1)) - 1) * step + 1, step))).otherwise(0)
    rows = df.withColumn("__k", low).withColumn("__c", coarse).withColumn("__r", fine.cast("int")).drop("__c")
    heads = sorted((r[0], r[1]) for r in rows.groupBy("__r").agg(F.max("__k")).collect())
    order = [r for r, _ in heads]
    first = {r: k for r, k in heads}
    above = dict(zip(order, order[1:] + order[:1], strict=True))
    head = F.get(array([first.get(r, 0) for r in range(max(order, default=0) + 1)]), F.col("__r"))
    to = F.get(array([above.get(r, 0) for r in range(max(order, default=0) + 1)]), F.col("__r")).cast("int")
    place = lambda r, ghost: F.struct(r.alias("r"), F.lit(ghost).alias("ghost"))
    placed = F.when(F.col("__k") == head, F.array(place(F.col("__r"), False), place(to, True))).otherwise(F.array(place(F.col("__r"), False)))
    rows = rows.withColumn("__p", F.explode_outer(placed)).withColumn("__r", F.col("__p.r")).withColumn("__g", F.col("__p.ghost")).drop("__p")
    w = Window.partitionBy("__r").orderBy(F.col("__g"), F.col("__k").desc(), *[F.col(c) for c in carry])
    return rows.withColumn("next", F.lead(F.struct(*carry)).over(w)).where("not __g").drop("__k", "__r", "__g")


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """For each row its fingerprint, that of an edited text, and likenesses: the columns of the query, in order.

    The edited text: the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document by descending doc_id (after the last: the first; with one row, itself). Null texts are empty. Rows that
    repeat an id follow each other by text; rows without an id come last. An empty table gives no row; other columns
    are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(with_sketch(rows, "text", "sketch"), "doc_id", ["text", "sketch"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", F.col("next.sketch").alias("following"), edited.alias("edited"))
    rows = with_sketch(rows, "edited", "changed")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), printed("sketch").alias("fingerprint"), printed("changed").alias("edited_fingerprint"),
        likeness("sketch", "changed").alias("near_edited"), likeness("sketch", "following").alias("near_next"),
    )
