"""Aligning sequences and judging predictions: matching blocks, zipped lines, ranks, keys, centroids, spectra."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.vectors import cosine, total

BLOCKS = ArrayType(StructType([StructField(n, IntegerType()) for n in ("a", "b", "size")]))

# The weights of the twelve tones in a major and in a minor key.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
TONES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


@F.pandas_udf(BLOCKS)
def matching_blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    """Array of (a, b, size): the runs of words that two word arrays share in order; one row (one song) at a time."""

    def one(x, y):
        if x is None or y is None:
            return None
        return [{"a": m.a, "b": m.b, "size": m.size} for m in SequenceMatcher(None, list(x), list(y), autojunk=False).get_matching_blocks() if m.size]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def matched_words(df: DataFrame, a: str, b: str, keep: list[str]) -> DataFrame:
    """(keep..., i, j, word): each word of a with the word of b it is aligned with."""
    blocks = df.withColumn("__m", F.explode(matching_blocks(F.col(a), F.col(b))))
    steps = blocks.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__m.size") - 1)))
    return steps.select(*keep, (F.col("__m.a") + F.col("__k")).alias("i"), (F.col("__m.b") + F.col("__k")).alias("j"), F.get(F.col(a), F.col("__m.a") + F.col("__k")).alias("word"))


def zipped_lines(raw: str, aligned: str) -> Column:
    """Raw lines with their aligned ones by position; null if the counts differ (the caller falls back)."""
    return F.when(F.size(raw) == F.size(aligned), F.arrays_zip(F.col(raw).alias("raw"), F.col(aligned).alias("aligned")))


def rank_of(scores: str, target: Column) -> Column:
    """How many scores are larger than the target's: 0 is top-1, under 5 is top-5. target counts from 0."""
    at = F.get(F.col(scores), target)
    return F.size(F.filter(scores, lambda s: s > at))


def top_accuracy(df: DataFrame, scores: str, target: str, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    ranked = df.select(rank_of(scores, F.col(target)).alias("r"))
    return ranked.agg(*[F.avg((F.col("r") < k).cast("double")).alias(f"top{k}") for k in ks])


def masked_accuracy(df: DataFrame, scores: str, target: str, neighbours: DataFrame) -> DataFrame:
    """One row: top1, top5 and near (the best one is the target or a neighbour of it) over the rows whose target isn't -100.

    neighbours(target, near array): a row for each class; it is joined by the target.
    """
    x = df.where(F.col(target) != -100).join(neighbours.select(F.col("target").alias(target), "near"), target, "left")
    best = F.array_position(scores, F.array_max(scores)).cast("int") - 1
    rank = rank_of(scores, F.col(target))
    hit = (best == F.col(target)) | F.coalesce(F.array_contains("near", best), F.lit(False))
    return x.agg(*[F.avg(c.cast("double")).alias(n) for n, c in (("top1", best == F.col(target)), ("top5", rank < 5), ("near", hit))])


def dims_for(variances: list[float], share: float = 0.9) -> int:
    """How many leading components explain that share of the variance that all of them explain."""
    total_, run = sum(variances), 0.0
    for k, v in enumerate(variances, 1):
        run += v
        if run >= share * total_ - 1e-12:
            return k
    return len(variances)


def correlation(a, b) -> Column:
    """Pearson's, of two arrays of one length; null where one doesn't vary."""
    n = F.size(a)
    ma, mb = total(a) / n, total(b) / n
    cross = total(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
    va, vb = total(F.transform(a, lambda x: (x - ma) * (x - ma))), total(F.transform(b, lambda y: (y - mb) * (y - mb)))
    return F.when((va > 0) & (vb > 0), cross / F.sqrt(va * vb))


def key_estimate(df: DataFrame, chroma: str, keep: list[str]) -> DataFrame:
    """(keep..., key, key_conf): the best of 24 rotated profiles by correlation, and its lead over the next."""
    profiles = [(f"{TONES[k]} {name}", [float(p[(i - k) % 12]) for i in range(12)]) for name, p in (("major", MAJOR), ("minor", MINOR)) for k in range(12)]
    rows = F.array(*[F.struct(F.lit(n).alias("key"), F.array(*[F.lit(v) for v in p]).alias("p")) for n, p in profiles])
    scored = df.withColumn("__s", F.transform(rows, lambda r: F.struct((-correlation(F.col(chroma), r["p"])).alias("c"), r["key"].alias("key"))))
    best = F.array_sort("__s")
    return scored.select(*keep, F.get(best, F.lit(0))["key"].alias("key"), (F.get(best, F.lit(1))["c"] - F.get(best, F.lit(0))["c"]).alias("key_conf"))


def nearest_centroid(df: DataFrame, vector: str, centroids: list[list[float]], out: str) -> DataFrame:
    """The number of the nearest of a few centroids (squared distance; ties to the smaller number)."""
    d = lambda c: total(F.zip_with(vector, F.array(*[F.lit(float(v)) for v in c]), lambda x, y: (x - y) * (x - y)))
    return df.withColumn(out, F.array_min(F.array(*[F.struct(d(c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centroids)]))["k"])


def centroids(df: DataFrame, vector: str, k: int, seed: int = 1, rounds: int = 20) -> list[list[float]]:
    """k-means by Spark's own implementation."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="__v").fit(df.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("__v")))
    return [c.tolist() for c in model.clusterCenters()]


def spectrum(df: DataFrame, vector: str, k: int) -> list[float]:
    """The explained variance of the first k principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(df.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("__v")))
    return model.explainedVariance.toArray().tolist()


def lag_cosine(frames: str) -> Column:
    """The mean cosine of each frame with the next, less the mean frame."""
    x = F.col(frames)
    n = F.size(x)
    mean = F.transform(F.get(x, F.lit(0)), lambda _, i: total(F.transform(x, lambda f: F.get(f, i))) / n)
    centred = F.transform(x, lambda f: F.zip_with(f, mean, lambda a, b: a - b))
    steps = F.zip_with(F.slice(centred, 1, n - 1), F.slice(centred, 2, n - 1), lambda a, b: cosine(a, b))
    return F.when(n > 1, total(F.filter(steps, lambda c: c.isNotNull())) / (n - 1))


def valid_reply(reply: Column, schema: str, sections: str, asked: Column) -> Column:
    """The JSON object in a model's reply if it has the wanted types and at least half of the sections asked for; else null."""
    parsed = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), schema)
    return F.when(parsed.isNotNull() & (F.size(F.map_keys(parsed[sections])) * 2 >= asked), parsed)


def unknown_keys(json: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that aren't allowed."""
    return F.array_except(F.json_object_keys(json), F.array(*[F.lit(a) for a in allowed]))
