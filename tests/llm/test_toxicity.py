"""Toxicity: held-out accuracy, the label model on planted voters, defined odd cases."""

import zlib

import numpy as np

from loomline.llm.queries import op8_toxicity
from loomline.llm.toxicity import ToxicityModel, fit, fit_model, label_model, score_toxicity


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op8_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)
    held = [(toxic[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in toxic]
    assert np.mean([p for t, p in held if t]) > 0.8  # one in ten toxic labels of this table marks a text without any marker word
    assert np.mean([p for t, p in held if not t]) < 0.01


def test_label_model_finds_accuracies_and_groups():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    votes = np.stack([(rng.random(4000) < np.where(y, a, b)) for a, b in ((0.7, 0.01), (0.5, 0.02), (0.6, 0.01))], 1).astype(float)
    votes = np.column_stack([votes, votes[:, 0]])  # the last repeats the first
    post, rates, group = label_model(votes, np.ones(4000), 0.2)
    assert np.mean((post > 0.5) == y) > 0.95
    assert abs(rates[1, 0] - 0.7) < 0.08 and rates[0, 0] < 0.03
    assert group[0] == group[3] and len(set(group.tolist())) == 3


def test_odd_rows(spark):
    model = ToxicityModel({"idiot": 6.0, "lowe*": 6.0}, -4.0, {})
    rows = [(1, None, "x"), (2, "", "x"), (3, "IDIOT!", "x"), (3, "IDIOT!", "x"), (4, "loweia", "x"), (None, "fine " * 50_000 + "idiot", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Score string")
    got = sorted((r.doc_id or 0, round(r.score, 4)) for r in score_toxicity(df, model).collect())
    assert got == [(0, 0.8808), (1, 0.018), (2, 0.018), (3, 0.8808), (3, 0.8808), (4, 0.8808)]
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert fit_model(df, empty).features == {}
    assert score_toxicity(df.limit(0), model).collect() == []


def test_without_toxic_labels_the_lexicon_still_votes():
    rows = [("you are an idiot and a moron", 0, 1.0), ("a quiet day", 0, 1.0)] * 5
    assert fit(rows).features
