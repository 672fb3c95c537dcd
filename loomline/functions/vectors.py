"""Vectors and error rates in higher-order functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .edits import edits
from .text import norm_wer


def once(value: Column, then) -> Column:
    """then(value) with value worked out one time, however often then uses it: a lambda's argument is bound."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a, b) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def norm(a) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x)))


def cosine(a, b) -> Column:
    """Null for a vector of length zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def normalised(a) -> Column:
    return once(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def z_scores(a, epsilon: float = 1e-6, digits: int = 3) -> Column:
    """Less the mean, over the population deviation and epsilon; rounded to even."""
    n = F.size(a)
    mean = total(F.transform(a, lambda x: x.cast("double"))) / n
    sd = lambda m: F.sqrt(total(F.transform(a, lambda x: (x - m) * (x - m))) / n)
    return once(mean, lambda m: once(sd(m), lambda d: F.transform(a, lambda x: F.bround((x - m) / (d + epsilon), digits))))


def mean_abs_diff(a, b) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y))) / F.size(a)


def mse(a, b) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))) / F.size(a)


def decibel(x: Column, epsilon: float = 1e-10) -> Column:
    return 10 * F.log10(F.greatest(x, F.lit(epsilon)))


def loudness(db: str) -> Column:
    """(mean, silent, tail): the mean, the part under -45 dB, the mean of the last fifth."""
    n = F.size(db)
    last = F.slice(F.col(db), F.floor(n * 0.8).cast("int") + 1, n)
    mean = lambda x: total(x) / F.greatest(F.size(x), F.lit(1))
    return F.struct(mean(F.col(db)).alias("mean"), (F.size(F.filter(db, lambda x: x < -45)) / n).alias("silent"), mean(last).alias("tail"))


def beat_stability(beats: str) -> Column:
    """1 less the deviation of the gaps over their mean."""
    x = F.col(beats)
    gaps = F.zip_with(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: a - b)
    spread = lambda mean: 1 - F.sqrt(total(F.transform(gaps, lambda g: (g - mean) * (g - mean))) / F.size(gaps)) / mean
    return F.when(F.size(gaps) > 0, once(total(gaps) / F.size(gaps), spread))


def letter_error(hyp: Column, ref: Column) -> Column:
    """Edit distance over letters without blanks, over the reference's length (one at least)."""
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    return edits(bare(hyp), bare(ref)) / F.greatest(F.length(bare(ref)), F.lit(1))


def word_edits(hyp: Column, ref: Column) -> Column:
    """Edit distance over words: each distinct word of the two becomes one character, then Spark's own distance. Null if either is null."""
    code = lambda k: F.format_string("%c", F.when(k < 50_000, k + 255).otherwise(k + 65_536).cast("int"))  # noqa: E731  past the surrogates
    coded = lambda x, words: F.array_join(F.transform(x, lambda w: code(F.array_position(words, w))), "")
    return once(F.array_distinct(F.concat(hyp, ref)), lambda words: F.levenshtein(coded(hyp, words), coded(ref, words)))


def words_of(x: Column) -> Column:
    return F.filter(F.split(norm_wer(x), " "), lambda w: w != "")


def wer(hyp: Column, ref: Column) -> Column:
    """Word error rate; NaN if either side is empty (an empty hypothesis drops out of a mean)."""
    return F.when((F.size(hyp) == 0) | (F.size(ref) == 0), F.lit(float("nan"))).otherwise(word_edits(hyp, ref) / F.size(ref))


def wer_strict(hyp: Column, ref: Column) -> Column:
    """The same, but an empty hypothesis is all wrong."""
    return F.when(F.size(ref) == 0, F.lit(float("nan"))).when(F.size(hyp) == 0, F.lit(1.0)).otherwise(word_edits(hyp, ref) / F.size(ref))


@F.pandas_udf(StringType())
def romanised(x: pd.Series) -> pd.Series:
    """Lower-case letters a-z and blanks: compatibility forms taken apart, marks dropped. Other scripts need a table of their own and are dropped."""

    def one(t):
        if t is None:
            return None
        flat = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
        return " ".join("".join(c if "a" <= c <= "z" else " " if c.isspace() else "" for c in flat).split())

    return x.map(one)


def instance_normalised(values: Column, guard: float = 1e-4) -> Column:
    """A channel over time less its mean, over its sample deviation and a guard; one value gives zero."""
    n = F.size(values)
    sums = F.aggregate(values, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda s, v: F.struct((s["a"] + v).alias("a"), (s["b"] + v * v).alias("b")))
    deviation = lambda s: F.sqrt(F.greatest(F.lit(0.0), (s["b"] - s["a"] * s["a"] / n) / F.greatest(n - 1, F.lit(1))))
    scaled = lambda s: once(deviation(s) + guard, lambda d: F.transform(values, lambda v: (v - s["a"] / n) / d))
    return once(sums, scaled)
