"""Toxicity by weak supervision: many voters, a generative model of their votes, a linear classifier.

Voters are lexicon words, patterns, and word starts that stand out in labelled rows. The label model takes a
document's unseen class to have made the votes: it estimates by expectation maximisation how often each voter
speaks up in either class, finds voters that agree more than that class explains, and lets each such group
count as one. Its posteriors are the labels on which a linear classifier over words and word starts is trained.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drawn, fit_in_one_task, frugal, without

WORD = re.compile(r"[^\W\d_]+")
#: The lexicon voters of every fit; what else a corpus holds is found in its labelled rows.
LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "dumb", "fool", "filth", "imbecile", "vermin", "freak", "jerk", "garbage", "ugly", "hate")
PATTERNS = {
    "insult": re.compile(rf"\byou(?:'re| are)? (?:an? |such an? |all )?(?:{'|'.join(LEXICON)})\b", re.I),
    "two close": re.compile(rf"\b(?:{'|'.join(LEXICON)})\W+(?:\w+\W+){{0,3}}(?:{'|'.join(LEXICON)})\b", re.I),
    "shouting": re.compile(r"(?:\b[A-Z]{3,}\b\W*){4,}!"),
}


@dataclass
class ToxicityModel:
    features: dict[str, float]  # as text_features() names them
    bias: float
    voters: dict[str, tuple[float, float]]  # how often each speaks up in clean, in toxic documents


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features(word: str) -> tuple[str, ...]:
    return (word, *(word[:n] + "*" for n in (4, 5, 6, 7, 8) if len(word) > n))


def text_features(text: str | None) -> set[str]:
    """Words, starts of words (ending in *), and starts that two words or more share (ending in **)."""
    n = Counter(f for w in words(text) for f in features(w))
    return n.keys() | {f + "*" for f, k in n.items() if k > 1}


def _stand_out(docs: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, named: list[str], kinds: int, most: int) -> list[int]:
    """Features (by number) that toxic documents have and clean ones hardly do, the best first; kinds: how many features there are in all."""
    n = [np.bincount(np.concatenate([d for d, t in zip(docs, toxic.tolist(), strict=True) if t == y] or [np.zeros(0, np.int64)]), minlength=len(named)) for y in (0, 1)]
    scale = [weight[toxic == y].mean() if (toxic == y).any() else 1.0 for y in (0, 1)]
    total = [max(1, int((toxic == y).sum())) for y in (0, 1)]
    p = total[1] / sum(total)
    chance = math.log(kinds + 1) + 1  # so that about no feature stands out by chance alone
    out = []
    for f in np.flatnonzero(n[1] * scale[1] > 20 * n[0] * scale[0]).tolist():
        k, clean = int(n[1][f]), int(n[0][f])
        q = k / (k + clean)
        if (k + clean) * (q * math.log(q / p) + (1 - q) * math.log(max(1 - q, 1e-9) / (1 - p))) > chance:
            out.append((-k * math.log((k + 0.5) / total[1] / ((clean + 0.5) / total[0])), named[f], f))
    return [f for _, _, f in sorted(out)[:most]]


def label_model(votes: np.ndarray, weight: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of the unseen class, each voter's rate of speaking up in either class, and each voter's group.

    votes: documents by voters, 1 or 0 (a silent voter abstains; that no voter speaks is evidence of its own, in
    the prior). Voters correlated beyond what the class explains form a group, of which the most telling vote counts.
    """
    n, m = votes.shape
    group = np.arange(m)
    heard = votes.sum(1)
    post = np.where(heard > 0, 0.5 + 0.45 * np.minimum(heard, 3) / 3, prior / 4)
    rates = np.full((2, m), 0.5)
    for turn in range(rounds):
        for y, p in enumerate((1 - post, post)):
            w = (p * weight)[:, None]
            rates[y] = ((votes * w).sum(0) + 0.05 * weight.mean()) / (w.sum() + weight.mean())
        rates[1] = np.maximum(rates[1], rates[0])  # a voter speaks for toxic
        if turn in (5, 15):  # correlations left once the class is known
            left = votes - (rates[0] + np.outer(post, rates[1] - rates[0]))
            cov = (left * weight[:, None]).T @ left / weight.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            near = np.abs(cov / np.outer(sd, sd)) > 0.4
            group = np.arange(m)
            for _ in range(m):  # the smallest voter reachable
                if ((low := np.where(near, group[None, :], m).min(1).clip(max=group)) == group).all():
                    break
                group = low
        lift = votes * np.log(rates[1] / rates[0])
        z = sum(lift[:, group == g].max(1) for g in np.unique(group)) + np.where(heard > 0, math.log(prior / (1 - prior)), -6.0)
        post = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    return post, rates, group


def fit(rows: list[tuple[str, int, float]], voters: int = 96, most: int = 4096, epochs: int = 12, seed: int = 1) -> ToxicityModel:
    """rows: text, toxic (1 or 0), weight. Labels choose voters and set the prior; posteriors train the classifier."""
    toxic, weight = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    prior = float(np.clip((toxic * weight).sum() / weight.sum(), 1e-3, 0.5))
    seen: Counter[str] = Counter()  # what no three toxic documents have can't stand out and isn't kept
    for text, y, _ in rows:
        if y:
            seen.update(text_features(text))
    named = sorted({*LEXICON, *(f for f, k in seen.items() if k >= 3)})
    kinds, number = len(seen) + len(LEXICON), {f: k for k, f in enumerate(named)}
    del seen
    docs = [np.array(sorted(number[f] for f in text_features(r[0]) if f in number), np.int64) for r in rows]
    speakers = list(dict.fromkeys([*(number[w] for w in LEXICON), *_stand_out(docs, toxic, weight, named, kinds, voters)]))
    votes = np.zeros((len(rows), len(speakers) + len(PATTERNS)))
    for k, (r, d) in enumerate(zip(rows, docs, strict=True)):
        votes[k] = [*np.isin(speakers, d), *(p.search(r[0] or "") is not None for p in PATTERNS.values())]
    speaks = votes.any(0)
    names = [x for x, s in zip([*(named[f] for f in speakers), *PATTERNS], speaks, strict=True) if s]
    votes = votes[:, speaks]
    if not names:
        return ToxicityModel({}, math.log(prior / (1 - prior)), {})
    post, rates, _ = label_model(votes, weight, prior)

    chosen = list(dict.fromkeys([*(number[n] for n in names if n not in PATTERNS), *_stand_out(docs, (post > 0.5).astype(int), weight, named, kinds, most)]))
    column = np.full(len(named), -1)
    column[chosen] = np.arange(len(chosen))
    x = [column[d][column[d] >= 0] for d in docs]
    w, slope, bias, bias_slope = np.zeros(len(chosen)), np.full(len(chosen), 1e-8), math.log(prior / (1 - prior)), 1e-8
    rng = np.random.default_rng(seed)
    scale = weight / weight.mean()
    for _ in range(epochs):
        for k in rng.permutation(len(x)):
            at = x[k]
            g = (1 / (1 + math.exp(-max(-40.0, min(40.0, bias + w[at].sum())))) - post[k]) * min(scale[k], 4.0)
            slope[at] += g * g
            w[at] -= 0.5 * g / np.sqrt(slope[at]) + 1e-5 * w[at]
            bias_slope += g * g
            bias = min(max(bias - 0.2 * g / math.sqrt(bias_slope), -4.0), -0.5)  # nothing speaks: clean; one sure word: toxic
    return ToxicityModel({named[f]: float(w[k]) for k, f in enumerate(chosen) if w[k]}, float(bias), {n: (float(a), float(b)) for n, a, b in zip(names, *rates, strict=True)})


def fit_model(docs: DataFrame, labels: DataFrame, learn: Column | None = None, toxic_bound: int = 3000, clean_bound: int = 6000) -> ToxicityModel:
    """A model from at most about so many labelled rows of either class (documented limits), drawn by a hash of the id.

    learn filters labels by doc_id. A document labelled more than once counts as toxic if any label says so; null
    labels and labels without a document don't count. Without a row to learn from, the model is empty: every score
    is that of its bias. The sample's ids are broadcast; the two limits bound them.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)" if learn is None else F.expr("doc_id is not null and toxic in (0, 1)") & learn)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    share = {y: min(1.0, b / max(1, n.get(y, 0))) for y, b in ((0, clean_bound), (1, toxic_bound))}
    sample = known.where(((F.col("toxic") == 1) & drawn(share[1], "toxic")) | ((F.col("toxic") == 0) & drawn(share[0], "toxic")))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.select("doc_id", "text", F.col("toxic").cast("int"))
    model = fit_in_one_task(rows, lambda got: fit([(r[1], r[2], 1 / share[r[2]]) for r in got]))
    return model or ToxicityModel({}, -4.0, {})


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score (0 to 1, over the whole text; higher: more likely toxic).

    Null and empty texts get the score of the bias. Every row gives a row; a column named like score_col (case
    aside) is replaced, others pass through.
    """
    rest = without(docs, score_col)
    at = rest.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known: dict[str, tuple[str, ...]] = {}

        def one(text: str | None) -> float:
            n: Counter[str] = Counter()
            for w in words(text):
                if (f := known.get(w)) is None:
                    if len(known) > 200_000:
                        known.clear()
                    f = known[w] = tuple(x for x in features(w) if x in m.features or x + "*" in m.features)
                if f:
                    n.update(f)
            hit = n.keys() | {f + "*" for f, k in n.items() if k > 1}
            z = m.bias + sum(m.features.get(f, 0.0) for f in sorted(hit))
            return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

        for x in batches:
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array([one(t) for t in x.column(at).to_pylist()], pa.float64())], names=[*x.schema.names, score_col])

    return rest.mapInArrow(frugal(run), rest.select("*", F.lit(None).cast("double").alias(score_col)).schema)
