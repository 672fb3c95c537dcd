"""Ordered operators: ends, gaps, sessions, boundaries, merges, fills. Folds run over one group's sorted array."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window


def line_ends(df: DataFrame, group: str, order: list[str], start: str, end: Column, out: str) -> DataFrame:
    """The next row's start (whatever the row holds), `end` for the last."""
    return df.withColumn(out, F.coalesce(F.lead(start).over(Window.partitionBy(group).orderBy(*order)), end))


def capped_end(t0: Column, following: Column, duration: Column, units: Column) -> Column:
    """min(max(following, t0), duration), and no later than t0 + 3 + 0.6 units."""
    return F.least(F.least(F.greatest(following, t0), duration), t0 + 3.0 + 0.6 * units)


def stanza_gap(df: DataFrame, group: str, order: list[str], t0: str, t1: str, silence: float = 6.0, step: float = 10.0) -> DataFrame:
    """gap: whether a stanza begins: silence since the last end, or step since the last start."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("gap", F.coalesce((F.col(t0) - F.lag(t1).over(w) >= silence) | (F.col(t0) - F.lag(t0).over(w) >= step), F.lit(False)))


def bounded_sessions(df: DataFrame, group: str, t0: str, t1: str, gap: float = 3.0, length: float = 20.0, lines: int = 6) -> DataFrame:
    """(group, k, start, end, n): sessions that also end at a length and a number of rows, which only a pass in order can tell.

    A task reads its groups' rows sorted and holds the open session alone, so a group may have any number of rows.
    """
    kind = df.schema[group].dataType
    rows = df.select(F.col(group).alias("g"), F.col(t0).cast("double").alias("a"), F.col(t1).cast("double").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, k, start, end, n = None, 0, 0.0, 0.0, 0
        for x in batches:
            out = []
            for h, a, b in zip(*[c.to_pylist() for c in x.columns], strict=True):
                if n and h == g and a - end < gap and a - start < length and n < lines:
                    end, n = b, n + 1
                    continue
                if n:
                    out.append((g, k, start, end, n))
                g, k, start, end, n = h, (k + 1 if n and h == g else 0), a, b, 1
            yield made(out, x.schema.field("g").type)
        if n:
            yield made([(g, k, start, end, n)], x.schema.field("g").type)

    def made(out: list, first: pa.DataType) -> pa.RecordBatch:
        types = (first, pa.int32(), pa.float64(), pa.float64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["g", "k", "start", "end", "n"])

    schema = StructType([StructField(group, kind), StructField("k", IntegerType()), StructField("start", DoubleType()), StructField("end", DoubleType()), StructField("n", IntegerType())])
    dealt = rows.where("a is not null").repartition("g").sortWithinPartitions("g", "a", "b")
    return dealt.mapInArrow(lambda b: (pa.RecordBatch.from_arrays(x.columns, names=[group, "k", "start", "end", "n"]) for x in run(b)), schema)


def repeated_marker(df: DataFrame, group: str, norm: Column, least: int = 6) -> DataFrame:
    """marker: chorus where the normalised text occurs twice or more in its group and has `least` characters, else verse."""
    n = F.count("*").over(Window.partitionBy(group, norm))
    return df.withColumn("marker", F.when((n >= 2) & (F.length(norm) >= least), "chorus").otherwise("verse"))


def boundaries(df: DataFrame, group: str, order: str, start: str, end: str, duration: str) -> DataFrame:
    """b: where each section begins: 0; the middle between aligned neighbours; half a second off beside an unaligned one;
    in a line between known boundaries elsewhere; never falling."""
    w = Window.partitionBy(group).orderBy(order)
    prev = F.lag(end).over(w)
    k = F.row_number().over(w) - 1
    n = F.count("*").over(Window.partitionBy(group))
    known = F.when(k == 0, F.lit(0.0)).when(prev.isNotNull() & F.col(start).isNotNull(), (prev + F.col(start)) / 2).when(F.col(start).isNotNull(), F.col(start) - 0.5).when(prev.isNotNull(), prev + 0.5)
    x = df.withColumn("__k", k).withColumn("__n", n).withColumn("__b", known.cast("double"))
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.struct(F.col("__k").alias("k"), F.col("__b").alias("b"))
    x = x.withColumn("__p", F.last(F.when(F.col("__b").isNotNull(), at), ignorenulls=True).over(back)).withColumn("__q", F.first(F.when(F.col("__b").isNotNull(), at), ignorenulls=True).over(on))
    q = F.coalesce("__q", F.struct(F.col("__n").alias("k"), F.col(duration).cast("double").alias("b")))
    line = F.col("__p.b") + (q["b"] - F.col("__p.b")) * (F.col("__k") - F.col("__p.k")) / (q["k"] - F.col("__p.k"))
    x = x.withColumn("__b", F.coalesce("__b", line))
    return x.withColumn("b", F.least(F.greatest(F.max("__b").over(back), F.lit(0.0)), F.col(duration).cast("double"))).drop("__k", "__n", "__b", "__p", "__q")


def merge_short(segments: str, least: int) -> Column:
    """Array of (text, f0, f1): a segment shorter than least gives its text and its start to the next; a short last one joins the one before."""
    kind = "struct<out:array<struct<text:string,f0:int,f1:int>>,pend:string,from:int>"

    def step(acc: Column, s: Column) -> Column:
        text = F.concat(acc["pend"], s["text"])
        f0 = F.coalesce(acc["from"], s["f0"])
        short = s["f1"] - f0 < least
        put = F.struct(F.concat(acc["out"], F.array(F.struct(text.alias("text"), f0.alias("f0"), s["f1"].alias("f1")))).alias("out"), F.lit("").alias("pend"), F.lit(None).cast("int").alias("from"))
        hold = F.struct(acc["out"].alias("out"), text.alias("pend"), f0.alias("from"))
        return F.when(short, hold).otherwise(put).cast(kind)

    def finish(acc: Column) -> Column:
        out, last = acc["out"], F.element_at(acc["out"], -1)
        end = F.element_at(F.col(segments), -1)["f1"]
        joined = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(F.concat(last["text"], acc["pend"]).alias("text"), last["f0"].alias("f0"), end.alias("f1"))))
        return F.when((acc["pend"] != "") & (F.size(out) > 0), joined).when(acc["pend"] != "", F.array(F.struct(acc["pend"].alias("text"), acc["from"].alias("f0"), end.alias("f1")))).otherwise(out)

    start = F.struct(F.array().cast("array<struct<text:string,f0:int,f1:int>>").alias("out"), F.lit("").alias("pend"), F.lit(None).cast("int").alias("from")).cast(kind)
    return F.aggregate(segments, start, step, finish)


def backfill(df: DataFrame, group: str, order: list[str], col: str, out: str) -> DataFrame:
    """The next value that isn't null, then the last one, then zero."""
    w = Window.partitionBy(group).orderBy(*order)
    nxt = F.first(col, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    last = F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.coalesce(nxt, last, F.lit(0).cast(df.schema[col].dataType)))


def cut_points(starts: str, duration: Column, least: float = 15.0, most: float = 30.0) -> Column:
    """Array of (a, b): from each cut to the last line start between least and most later, else most; what is left is the last."""
    kind = "struct<cuts:array<double>>"
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(duration / least).cast("int"), F.lit(1)))

    def step(acc: Column, _: Column) -> Column:
        at = F.element_at(acc["cuts"], -1)
        snap = F.array_max(F.filter(F.col(starts), lambda s: (s >= at + least) & (s <= at + most)))
        return F.when(duration - at > most, F.struct(F.concat(acc["cuts"], F.array(F.coalesce(snap, at + most))).alias("cuts"))).otherwise(acc).cast(kind)

    cuts = F.concat(F.aggregate(steps, F.struct(F.array(F.lit(0.0)).alias("cuts")).cast(kind), step)["cuts"], F.array(duration))
    return F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def first_per(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def stripped_ends(df: DataFrame, group: str, order: list[str], drop: Column) -> DataFrame:
    """Without the rows that `drop` holds for in an unbroken run at either end of the group."""
    w = Window.partitionBy(group).orderBy(*order)
    head = F.every(drop).over(w.rowsBetween(Window.unboundedPreceding, 0))
    tail = F.every(drop).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("__x", head | tail).where("not __x").drop("__x")


def part_of(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """part: the row's ordinal in its group modulo n."""
    return df.withColumn("part", (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) % n)


def collapsed(symbols: str, blank: int = 0) -> Column:
    """Repeats in a row once, blanks out."""
    return F.filter(symbols, lambda x, i: (x != blank) & ((i == 0) | (x != F.get(F.col(symbols), i - 1))))


def cursors(starts: str, blocks: int, size: int) -> Column:
    """Array of (c, a): how many starts lie before each block of `size` frames, and how many come in it."""
    c = lambda i: F.size(F.filter(F.col(starts), lambda s: s < i * size))
    return F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.struct(c(i).alias("c"), (c(i + 1) - c(i)).alias("a")))


def id_window(ids: str, at: Column, before: int, after: int, pad: int, end: int) -> Column:
    """ids from at - before to at + after - 1, pad before the first and end behind the last."""
    return F.transform(F.sequence(at - before, at + after - 1), lambda i: F.when(i < 0, pad).when(i >= F.size(ids), end).otherwise(F.get(F.col(ids), i.cast("int"))))


def chunks(n: Column, size: int, margin: int) -> Column:
    """Array of (a, b, lo, hi): chunks of size frames, and with margins clipped at the ends."""
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size)), lambda a: F.struct(a.alias("a"), F.least(a + size, n).alias("b"), F.greatest(a - margin, F.lit(0)).alias("lo"), F.least(a + size + margin, n).alias("hi")))


def half_windows(n: Column, size: int) -> Column:
    """Windows of size at half steps, the last set back to the end; of each its centre is kept, at both ends all."""
    last = F.greatest(n - size, F.lit(0))
    at = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(size // 2)), F.array(last)))
    return F.transform(at, lambda a: F.struct(a.alias("a"), F.when(a == 0, 0).otherwise(a + size // 4).alias("lo"), F.when(a == last, n).otherwise(a + size - size // 4).alias("hi")))


def trailing_count(df: DataFrame, group: str, order: str, symbol: str, n: int) -> DataFrame:
    """seen: how often the row's symbol occurs in the n rows before it."""
    rows = F.collect_list(symbol).over(Window.partitionBy(group).orderBy(order).rowsBetween(-n, -1))
    return df.withColumn("seen", F.size(F.filter(rows, lambda x: x == F.col(symbol))))


def nucleus(df: DataFrame, group: str, symbol: str, p: str, top_p: float | Column) -> DataFrame:
    """The likeliest symbols of a distribution while what came before is under top_p, with p normalised. Whole numbers keep sums exact."""
    w = Window.partitionBy(group).orderBy(F.desc(p), symbol)
    kept = df.withColumn("__before", F.sum(p).over(w) - F.col(p)).where(F.col("__before") < top_p).drop("__before")
    return kept.withColumn("p_kept", F.col(p) / F.sum(p).over(Window.partitionBy(group)))


def crossfaded(df: DataFrame, key: list[str], value: str, weight: str, out: str) -> DataFrame:
    """Overlapping pieces added by weight and normalised."""
    return df.groupBy(*key).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(out))


def span_cap(f0: Column, f1: Column, letters: Column, rate: float) -> Column:
    return F.least(f1, f0 + rate * (2 + 0.2 * letters))


def interleaved(lines: str, frames: int, budget: int) -> Column:
    """Array of (kind, frame, letter): frames 0, 1, ... with each line's letters and an end mark (kind 1, letter 1) before its start frame.

    Starts are clamped to the timeline and sorted (ties in the given order); a line is left out once the letters so far and its own would pass the budget.
    """
    last = F.lit(frames - 1)
    placed = F.array_sort(F.transform(lines, lambda s, i: F.struct(F.greatest(F.lit(0), F.least(s["at"], last)).alias("at"), i.alias("i"), s["ids"].alias("ids"))))
    kind = "struct<n:int,out:array<struct<at:int,i:int,ids:array<int>>>>"
    take = lambda acc, s: F.when(acc["n"] + F.size(s["ids"]) + 1 <= budget, F.struct((acc["n"] + F.size(s["ids"]) + 1).alias("n"), F.concat(acc["out"], F.array(s)).alias("out"))).otherwise(acc).cast(kind)
    empty = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<at:int,i:int,ids:array<int>>>").alias("out")).cast(kind)
    kept = F.aggregate(placed, empty, take)["out"]
    letter = lambda x: F.struct(F.lit(1).alias("kind"), F.lit(-1).alias("frame"), x.alias("letter"))
    line = lambda s: F.transform(F.concat(s["ids"], F.array(F.lit(1))), letter)
    at = lambda t: F.concat(F.flatten(F.transform(F.filter(kept, lambda s: s["at"] == t), line)), F.array(F.struct(F.lit(0).alias("kind"), t.alias("frame"), F.lit(0).alias("letter"))))
    return F.flatten(F.transform(F.sequence(F.lit(0), last), at))
