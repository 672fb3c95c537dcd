"""Language identification: held-out accuracy, defined odd cases, and logits against a plain version."""

import zlib

import numpy as np

from loomline.llm.langid import LanguageModel, folded, mean_logits, predict_language
from loomline.llm.queries import op6_langid


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = op6_langid(spark, sf).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    # calibrated: the mean score is close to the accuracy
    assert abs(np.mean([r.score for r in held]) - np.mean([r.lang_pred == lang[r.doc_id] for r in held])) < 0.03


def plain_logits(model, raw):
    total, count = np.zeros(len(model.langs)), 0
    for n in model.orders:
        for i in range(len(raw) - n + 1):
            h = (2166136261 + n) % 2**32
            for c in raw[i : i + n].tolist():
                h = (h ^ c) * 16777619 % 2**32
            total += model.logits[(h ^ h >> 15) & (2**model.bits - 1)]
            count += 1
    return total / max(count, 1) + model.bias


def test_steps_equal_the_plain_version(monkeypatch):
    rng = np.random.default_rng(0)
    model = LanguageModel(["a", "b"], rng.normal(size=(256, 2)).astype(np.float32), np.array([0.1, -0.1]), 1.0, 0.5, (2, 3, 4), 8)
    text = "Où est l'été? 12 34 ß".encode() * 9
    monkeypatch.setattr("loomline.llm.langid.STEP", 16)
    for t in (text, b"", b"a", b"ab"):
        assert np.allclose(mean_logits(model, t), plain_logits(model, folded(t)), atol=1e-5)


def test_odd_rows(spark):
    model = LanguageModel(["a", "b"], np.zeros((256, 2), np.float32), np.array([1.0, 0.0]), 1.0, 0.5, (2, 3), 8)
    rows = [(1, None, "x"), (2, "", "x"), (3, "12 - !!", "x"), (4, "é", "x"), (4, "é", "x"), (None, "word " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, SCORE string")
    got = sorted((r.doc_id or 0, r.lang_pred, round(r.score, 6), r.accepted) for r in predict_language(df, model).collect())
    s = round(float(np.e / (1 + np.e)), 6)
    assert got == [(0, "a", s, True), (1, "und", 0.0, False), (2, "und", 0.0, False), (3, "und", 0.0, False), (4, "a", s, True), (4, "a", s, True)]
    assert predict_language(df.limit(0), model).collect() == []
    assert {r.lang_pred for r in predict_language(df, None).collect()} == {"und"}
