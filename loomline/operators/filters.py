"""Predicates, reasons and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(reasons: dict[str, Column]) -> Column:
    """The name of the first predicate that holds, null if none does: a row counts under one reason."""
    return F.coalesce(*[F.when(p, F.lit(k)) for k, p in reasons.items()])


def reason_counts(df: DataFrame, reasons: dict[str, Column], kept: str = "kept") -> DataFrame:
    return df.groupBy(F.coalesce(first_reason(reasons), F.lit(kept)).alias("reason")).agg(F.count("*").alias("n"))


def flags(named: dict[str, Column]) -> Column:
    """The names of the predicates that hold, in order."""
    return F.array_compact(F.array(*[F.when(p, F.lit(k)) for k, p in named.items()]))


def has_none(col: str, bad: list[str]) -> Column:
    return ~F.arrays_overlap(F.col(col), F.array(*[F.lit(b) for b in bad]))


def tier(x: Column, tiers: list[tuple[float, str]], otherwise: str) -> Column:
    """The first name whose bound x reaches; bounds fall."""
    return reduce(lambda out, t: out.when(x >= t[0], t[1]), tiers[1:], F.when(x >= tiers[0][0], tiers[0][1])).otherwise(otherwise)


def timing_flags(lines: str, duration: Column, units) -> Column:
    """lyr_few, lyr_after_end, lyr_zero, lyr_fast, lyr_partial for an array of structs t0, t1n, text."""
    x, n = F.col(lines), F.size(lines)
    length = lambda s: s["t1n"] - s["t0"]
    rates = F.array_sort(F.transform(F.filter(x, lambda s: s["t1n"] > s["t0"]), lambda s: units(s["text"]) / F.greatest(length(s), F.lit(0.1))))
    m = F.size(rates)
    middle = (F.get(rates, ((m - 1) / 2).cast("int")) + F.get(rates, (m / 2).cast("int"))) / 2
    first, last = F.get(x, F.lit(0))["t0"], F.get(x, n - 1)["t0"]
    return flags({
        "lyr_few": n < 4,
        "lyr_after_end": F.exists(x, lambda s: s["t0"] > duration + 1),
        "lyr_zero": F.size(F.filter(x, lambda s: length(s) <= 0.05)) > 0.1 * n,
        "lyr_fast": (m > 0) & (middle > 10),
        "lyr_partial": (n > 4) & (last - first < 0.3 * duration),
    })


def alignment_reason(score: Column, n_align: Column, n_words: Column, sections: str, error: Column | None = None, least: float = 0.04, least_part: float = 0.8, least_pace: float = 0.12) -> Column:
    """Why an alignment isn't used, null if it is: its own error or no_score, low_score, unromanized (too few words aligned),
    squeezed (a section of 8 aligned words or more in less time than least_pace seconds each), no_aligned_section.

    sections: array of structs with start, end and n_align, start null where nothing is aligned.
    """
    squeezed = F.exists(sections, lambda s: s["start"].isNotNull() & (s["n_align"] >= 8) & (s["end"] - s["start"] < least_pace * s["n_align"]))
    none = ~F.exists(sections, lambda s: s["start"].isNotNull())
    reason = first_reason({"no_score": score.isNull(), "low_score": score < least, "unromanized": n_align < least_part * F.greatest(n_words, F.lit(1)), "squeezed": squeezed, "no_aligned_section": none})
    return reason if error is None else F.coalesce(error, reason)


def unique_or_raise(df: DataFrame, key: str) -> DataFrame:
    """df, failing when a key occurs twice."""
    from pyspark.sql.window import Window

    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("__n", F.when(n > 1, F.raise_error(F.concat(F.lit(f"{key} occurs more than once: "), F.col(key).cast("string")))).otherwise(n)).where("__n = 1").drop("__n")


def good_word_times(lines: Column, uniform: Column) -> Column:
    """Whether a word-timed file is good: four lines or more, a fifth of them at most with words all as long."""
    return (lines >= 4) & (uniform <= 0.2 * lines)


def present(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of a list that df has, in the list's order."""
    return df.select(*[F.col(f"`{n}`") for n in names if n in df.columns])


def kind_of_lyrics(kind: Column, lines: Column) -> Column:
    """A row's own kind; without one timed where there are lines, else none."""
    return F.when(F.coalesce(kind, F.lit("")) != "", kind).when(F.size(lines) > 0, "timed").otherwise("none")
