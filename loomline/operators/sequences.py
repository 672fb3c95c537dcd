"""Token documents as arrays: assembly, parsing, packing, codes and codebooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The ids of the token layouts.
EOD, SOA, EOA, CODEC_A, CODEC_B, SOS = 65536, 65537, 65538, 65539, 65540, 65541
CODE_BASE, CODES_A, CODES_B = 65544, 1024, 32768


def _ids(*x: int) -> Column:
    return F.array(*[F.lit(i) for i in x])


def song_document(text: Column, codes: Column, codec: int = CODEC_A) -> Column:
    """text EOD SOA codec codes EOA 0."""
    return F.concat(text, _ids(EOD, SOA, codec), F.transform(codes, lambda c: c + CODE_BASE), _ids(EOA, 0))


def section_document(header: Column, sections: Column, codes: Column) -> Column:
    """header EOD (SOS text SOA codec codes EOA)* 0, each section (text, f0, f1) with its slice of codes."""
    part = lambda s: F.concat(_ids(SOS), s["text"], _ids(SOA, CODEC_B), F.transform(F.slice(codes, s["f0"] + 1, s["f1"] - s["f0"]), lambda c: c + CODE_BASE), _ids(EOA))
    return F.concat(header, _ids(EOD), F.flatten(F.transform(sections, part)), _ids(0))


def section_length(header: Column, sections: Column) -> Column:
    """What section_document would be long, without making it."""
    return F.size(header) + 2 + F.aggregate(sections, F.lit(0), lambda n, s: n + 4 + F.size(s["text"]) + s["f1"] - s["f0"])


def parse_sections(doc: str) -> Column:
    """Array of (text, codes) of a section document."""
    x = F.col(doc)
    at = lambda t: F.filter(F.transform(x, lambda v, i: F.when(v == t, i)), lambda i: i.isNotNull())
    between = lambda a, b: F.slice(x, a + 2, F.greatest(b - a - 1, F.lit(0)))
    marks = F.zip_with(at(SOS), F.zip_with(at(SOA), at(EOA), lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda a, m: F.struct(a.alias("a"), m["s"].alias("s"), m["e"].alias("e")))
    return F.transform(marks, lambda m: F.struct(between(m["a"], m["s"]).alias("text"), F.transform(between(m["s"] + 1, m["e"]), lambda c: c - CODE_BASE).alias("codes")))


def header_of(doc: str) -> Column:
    return F.slice(F.col(doc), 1, F.greatest(F.array_position(doc, EOD).cast("int") - 1, F.lit(0)))


def position_tags(doc: str, head: int = 50) -> Column:
    """A tag for each position but the first (what is predicted there): c0 for the first codes of a section, c for the others, b for marks, t for text."""
    x = F.col(doc)
    mark = lambda v: v.isin(SOA, SOS, EOA, EOD)
    starts = F.concat(_ids(0), F.filter(F.transform(x, lambda v, i: F.when(mark(v) & (i > 0), i)), lambda i: i.isNotNull()))
    runs = F.zip_with(starts, F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(x))), lambda a, b: F.slice(x, a + 1, b - a))  # each from a mark to the next
    last = lambda r: F.coalesce(F.get(F.filter(F.transform(r, lambda v, i: F.when(v >= CODE_BASE, i)), lambda i: i.isNotNull()), F.lit(head - 1)), F.size(r))
    known = F.transform(runs, lambda r: F.struct(r.alias("r"), last(r).alias("last")))  # where the run's first `head` codes end
    tag = lambda v, i, end: F.when(v >= CODE_BASE, F.when(i <= end, "c0").otherwise("c")).when((v >= EOD) | (v == 0), "b").otherwise("t")
    tags = F.flatten(F.transform(known, lambda s: F.transform(s["r"], lambda v, i: tag(v, i, s["last"]))))
    return F.slice(tags, 2, F.greatest(F.size(tags) - 1, F.lit(0)))


def contiguous(sections: str, n: Column) -> Column:
    """Whether sections cover [0, n) without gap or overlap."""
    ends = F.transform(sections, lambda s: s["f1"])
    starts = F.transform(sections, lambda s: s["f0"])
    return (F.size(sections) > 0) & (F.concat(_ids(0), ends) == F.concat(starts, F.array(n)))


def packed(df: DataFrame, order: list[str], size: Column, groups: str) -> DataFrame:
    """offset: where each row's values begin in its shard's flat stream (a running sum within the shard)."""
    w = Window.partitionBy(groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("size", size).withColumn("offset", F.coalesce(F.sum("size").over(w), F.lit(0)))


def write_packed(docs: DataFrame, tokens: str, shard: str, order: list[str], path: str) -> None:
    """Shards as Parquet of (shard, ord, offset, size, tokens), in order; Spark's commit makes the write whole or nothing."""
    out = packed(docs, order, F.size(tokens), shard).withColumn("ord", F.row_number().over(Window.partitionBy(shard).orderBy(*order)) - 1)
    out.select(shard, "ord", "offset", "size", F.col(tokens).alias("tokens")).repartition(shard).sortWithinPartitions(shard, "ord").write.partitionBy(shard).parquet(path)


def flat(packed_docs: DataFrame, shard: str) -> DataFrame:
    """(shard, at, token): the stream of each shard."""
    return packed_docs.select(shard, "offset", F.posexplode("tokens").alias("i", "token")).select(shard, (F.col("offset") + F.col("i")).alias("at"), "token")


def fsq_basis(levels: list[int]) -> list[int]:
    out = [1]
    for n in levels[:-1]:
        out.append(out[-1] * n)
    return out


def fsq_index(codes: str, levels: list[int]) -> Column:
    """The mixed-radix number of digits."""
    return F.aggregate(F.zip_with(codes, _ids(*fsq_basis(levels)), lambda c, b: c * b), F.lit(0), lambda s, x: s + x)


def fsq_digits(index: Column, levels: list[int]) -> Column:
    return F.array(*[(F.floor(index / b) % n).cast("int") for b, n in zip(fsq_basis(levels), levels, strict=True)])


def fsq_quantise(values: str, levels: list[int]) -> Column:
    """Values in [-1, 1] to the nearest of each axis's levels, ties to even."""
    return F.zip_with(values, _ids(*levels), lambda v, n: F.bround((F.greatest(F.least(v, F.lit(1.0)), F.lit(-1.0)) + 1) / 2 * (n - 1)).cast("int"))


def with_offsets(codes: str, size: int = CODES_A) -> Column:
    """Codes of K books (array of arrays) each in a range of its own."""
    return F.transform(codes, lambda row, k: F.transform(row, lambda c: c + k * size))


def interleave(codes: str) -> Column:
    """K rows of T codes as one row, time first."""
    rows = F.col(codes)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(F.get(rows, F.lit(0))) - 1), lambda t: F.transform(rows, lambda r: F.get(r, t))))


def deinterleave(flat_codes: str, books: int) -> Column:
    x = F.col(flat_codes)
    return F.transform(F.sequence(F.lit(0), F.lit(books - 1)), lambda k: F.filter(x, lambda v, i: i % books == k))


def balanced_marks(doc: str) -> Column:
    """As many starts as ends of audio."""
    n = lambda t: F.size(F.filter(doc, lambda v: v == t))
    return n(SOA) == n(EOA)


def repeat_rate(codes: str) -> Column:
    """The part of steps that repeat the one before."""
    x = F.col(codes)
    same = F.filter(x, lambda v, i: (i > 0) & (v == F.get(x, i - 1)))
    return F.size(same) / F.greatest(F.size(x) - 1, F.lit(1))


def mode_imputed(codes: str, low: int, high: int) -> Column:
    """Values outside [low, high] replaced by the most frequent value inside (ties: the smallest); as they are if there is none."""
    inside = F.filter(codes, lambda v: v.between(low, high))
    counted = F.transform(F.array_distinct(inside), lambda v: F.struct((-F.size(F.filter(inside, lambda w: w == v))).alias("n"), v.alias("v")))
    best = F.array_min(counted)["v"]
    return F.transform(codes, lambda v: F.when(v.between(low, high), v).otherwise(F.coalesce(best, v)))
