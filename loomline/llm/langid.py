"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are its byte n-grams (ASCII letters lower-cased, every run of other ASCII characters one
blank), hashed into buckets. Its vector is the mean of their embeddings; a linear softmax names the language.
Embeddings and softmax are trained by stochastic gradient descent in numpy. A temperature fitted on rows kept
from training calibrates the score, and a threshold on the score says what to reject.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drawn, fit_in_one_task, without

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)
STEP = 1 << 20  # bytes of text worked on at once


@dataclass
class LanguageModel:
    """logits: for each bucket, its embedding times the softmax's weights; the rest as named."""

    langs: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    accept: float  # scores below this are rejected
    orders: tuple[int, ...]
    bits: int


def buckets(raw: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each byte of folded text."""
    wide = raw.astype(np.uint32)
    for n in orders:
        if len(wide) >= n:
            h = np.full(len(wide) - n + 1, 2166136261 + n, np.uint32)
            for k in range(n):
                h = (h ^ wide[k : len(wide) - n + 1 + k]) * np.uint32(16777619)
            yield (h ^ (h >> np.uint32(15))) >> np.uint32(0) & np.uint32((1 << bits) - 1)


def folded(text: bytes) -> np.ndarray:
    raw = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)]
    return raw[np.concatenate(([True], (raw[1:] != 32) | (raw[:-1] != 32)))]


def mean_logits(model: LanguageModel, text: bytes) -> np.ndarray:
    """The whole text, in steps that overlap by the longest n-gram less one byte."""
    raw, total, count = folded(text), np.zeros(len(model.langs)), 0
    for start in range(0, len(raw), STEP):
        for n, at in zip(model.orders, buckets(raw[start : start + STEP + max(model.orders) - 1], model.orders, model.bits), strict=False):
            at = at[:STEP]
            total += np.stack([model.logits[:, k].take(at).sum(dtype=np.float64) for k in range(len(model.langs))])
            count += len(at)
    return total / max(count, 1) + model.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(texts: list[bytes], langs: list[str], dim: int = 12, bits: int = 15, orders: tuple[int, ...] = (2, 3, 4), epochs: int = 6, rate: float = 0.6, keep: int = 5, seed: int = 1) -> LanguageModel:
    """Every keep-th row sets the temperature and the threshold; the others train.

    Each step takes one text, in a seeded order; a text's n-grams are counted first, so a step costs
    its distinct n-grams.
    """
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    grams = []
    for t in texts:
        at = np.concatenate([*buckets(folded(t), orders, bits), np.zeros(0, np.uint32)])
        ids, n = np.unique(at, return_counts=True)
        grams.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    w, b = np.zeros((dim, len(names)), np.float32), np.zeros(len(names), np.float32)
    train = np.array([k for k in range(len(texts)) if k % keep or len(texts) <= keep])
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for k in rng.permutation(train):
            ids, n = grams[k]
            hidden = n @ emb[ids] if len(ids) else np.zeros(dim, np.float32)
            delta = softmax((hidden @ w + b).astype(np.float64)).astype(np.float32)
            delta[y[k]] -= 1
            now = rate * (1 - done / steps) + 1e-3
            back = w @ delta
            w -= now * np.outer(hidden, delta)
            b -= 0.1 * now * delta
            if len(ids):
                emb[ids] -= (now * 8) * n[:, None] * back
            done += 1
    model = LanguageModel(names, np.ascontiguousarray((emb @ w).astype(np.float32)), b.astype(np.float64), 1.0, 0.0, orders, bits)
    aside = [k for k in range(len(texts)) if k % keep == 0] or list(range(len(texts)))
    z = np.stack([mean_logits(model, texts[k]) for k in aside]) if aside else np.zeros((0, len(names)))
    if len(z):
        loss = {t: -np.log(np.maximum(softmax(z / t)[np.arange(len(z)), y[aside]], 1e-12)).mean() for t in np.geomspace(0.02, 5, 60)}
        model.temperature = float(min(loss, key=loss.get))
        p = softmax(z / model.temperature)
        right = p.argmax(1) == y[aside]
        model.accept = float(min(np.quantile(p.max(1)[right], 0.005) if right.any() else 0.5, 0.9))
    return model


def fit_model(docs: DataFrame, learn: Column, bound: int = 4000, lang_col: str = "lang", text_col: str = "text", key: str = "doc_id") -> LanguageModel | None:
    """A model from about `bound` labelled rows (a documented limit), drawn by a hash of the key; None without a labelled row.

    Counting reads no text. The sample is trained on in one task; only the model comes to the driver
    (2**bits times the number of languages numbers).
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull())
    total = rows.count()
    if not total:
        return None
    sample = rows.where(F.col(text_col).isNotNull() & drawn(bound / total, "langid", key))
    return fit_in_one_task(sample.select(F.col(key).cast("string"), lang_col, F.col(text_col).cast("string")), lambda got: fit([r[2].encode() for r in got], [r[1] for r in got]))


def predict_language(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and accepted.

    lang_pred is a learned language, or `und` with score 0, not accepted, if the text is null or has no
    letter (or nothing was learned). accepted: the score reaches the model's threshold. Every row gives a row;
    ties go to the language first in order; columns of those names (case aside) are replaced, others pass through.
    """
    rest = without(docs, "lang_pred", "score", "accepted")
    at = rest.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(text: str | None) -> tuple[str, float, bool]:
        m = shared.value
        if m is None or not text or not _LETTER.search(text):
            return "und", 0.0, False
        p = softmax(mean_logits(m, text.encode("utf-8", "surrogatepass")) / m.temperature)
        return m.langs[int(p.argmax())], float(p.max()), bool(p.max() >= m.accept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            made = [one(t) for t in x.column(at).to_pylist()]
            cols = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*x.columns, *cols], names=[*x.schema.names, "lang_pred", "score", "accepted"])

    null = [F.lit(None).cast(k).alias(n) for n, k in (("lang_pred", "string"), ("score", "double"), ("accepted", "boolean"))]
    return rest.mapInArrow(run, rest.select("*", *null).schema)
