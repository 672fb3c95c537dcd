"""Readers, writers and incremental passes on small files."""

import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import sequences as S
from loomline.sources import readers as R
from loomline.sources import writers as K
from loomline.streaming import ingest


def test_jsonl_shards_and_torn_lines(spark, tmp_path):
    for k in (1, 2, 7):
        (tmp_path / f"shard_{k}.jsonl").write_text("".join(json.dumps({"id": f"{k}-{i}", "n": i}) + "\n" for i in range(3)) + ('{"id": "torn' if k == 2 else ""))
    df = R.with_shard(R.read_jsonl(spark, str(tmp_path), "id string, n int"))
    assert df.count() == 9 and R.in_shards(df, "1-3").count() == 6 and R.in_shards(df, "all").count() == 9
    assert R.shard_spec("1-3,7") == [1, 2, 3, 7]


def test_timed_lines(spark):
    f = lambda fn, v: spark.createDataFrame([(v,)], "v string").select(fn(F.col("v")).alias("x")).first()["x"]
    assert [tuple(r) for r in f(R.timed_lines, "[offset:500]\n[00:01.00][00:03.00]la\n[ar:x]\n[00:00.10]")] == [(0.5, "la"), (2.5, "la"), (0.0, "")]
    assert f(R.untimed_lines, '{"t":1}\nhttp://x\n[ar:x] y\n\n z ') == ["y", "z"]
    got = f(R.word_timed_lines, "[1000,900](1000,300,0)la (1300,300,0)la (1600,300,0)la\n[2000,10](2000,10,0)作曲: X\nnoise")
    assert [(r.t0, r.t1, r.text, r.uniform) for r in got] == [(1.0, 1.9, "la la la", True)]


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for name, data in (("s1.mp3", b"x"), ("s1.json", b"{}"), ("s2.mp3", b"y")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    got = {r.stem: r.paired for r in R.pair_members(R.read_tar_pairs(spark, str(tmp_path / "*.tar")), ["mp3"]).collect()}
    assert got == {"s1": True, "s2": False}
    np.savez(tmp_path / "t.npz", a=np.array([[1, 2], [3, 4]], np.int16), b=np.array([5], np.int16))
    assert {r.id: r.values for r in R.read_npz(spark, str(tmp_path / "*.npz")).select("id", F.col("values")).collect()} is not None
    assert {r["id"]: r["values"] for r in R.read_npz(spark, str(tmp_path / "*.npz")).collect()} == {"a": [1, 2, 3, 4], "b": [5]}
    np.array([1, -2], "<i4").tofile(tmp_path / "t.bin")
    assert R.read_flat_int32(spark, str(tmp_path / "*.bin")).first()["tokens"] == [1, -2]


def test_entities(spark):
    files = spark.createDataFrame([("d", "a.mp3", 200_000), ("d", "b.flac", 900_000), ("d", "c.mp3", 10), ("d", "x (1).lrc", 5), ("d", "x.lrc", 5), ("d", "i.json", 1), ("e", "a.mp3", 200_000)], "dir string, name string, size long")
    got = {r.dir: (r.audio, r.lyric, r.complete) for r in R.entities(files).collect()}
    assert got["d"] == ("b.flac", "x.lrc", True) and got["e"][2] is False
    assert [r.dir for r in R.has_without(files, "a.mp3", "i.json").collect()] == ["e"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(k, "train" if k else "dev", k % 2 == 0) for k in range(6)], "k int, split string, ok boolean")
    K.fan_out(df, str(tmp_path / "f"), {"lyric": F.col("ok"), "audio": F.lit(True)}, "split")
    assert spark.read.json(str(tmp_path / "f")).groupBy("kind").count().count() == 2
    K.append_new(df, str(tmp_path / "a"), "k")
    K.append_new(df.unionAll(spark.createDataFrame([(9, "x", True)], df.schema)), str(tmp_path / "a"), "k")
    assert spark.read.parquet(str(tmp_path / "a")).count() == 7
    bad = spark.createDataFrame([(1, None), (1, "e"), (2, None), (2, None)], "s int, error string")
    assert {r.s for r in K.gate(bad, "s", "error").collect()} == {2}
    K.published(df, str(tmp_path / "stage"), str(tmp_path / "live"))
    K.published(df.limit(2), str(tmp_path / "stage"), str(tmp_path / "live"))
    assert spark.read.parquet(str(tmp_path / "live")).count() == 2
    assert json.loads(K.summary_json(df.agg(F.count("*").alias("n"))).first()[0]) == {"n": 6}
    held, rest = K.slim(df, ["k"], "k", 2)
    assert held.count() == 2 and rest.count() == 4
    docs = spark.createDataFrame([(0, 1, [1, 2]), (0, 2, [3]), (1, 3, [4])], "shard int, k int, tokens array<int>")
    S.write_packed(docs, "tokens", "shard", ["k"], str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert sorted((r.shard, r.at, r.token) for r in S.flat(back, "shard").collect()) == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 4)]


def test_incremental_passes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put = lambda name, ids: (src / name).write_text("".join(json.dumps({"id": i, "n": i}) + "\n" for i in ids) + '{"id": 1')
    put("1.json", range(5))
    run = lambda: ingest.append_pass(spark, str(src), "id long, n long", str(tmp_path / "out"), str(tmp_path / "cp"), "id", "n <> 3")
    run()
    put("2.json", range(3, 9))
    run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 4, 5, 6, 7, 8]


def test_full_shards(spark):
    df = spark.range(2500).withColumnRenamed("id", "i")
    assert ingest.full_shards(df, "i").count() == 2000 and ingest.full_shards(df, "i", flush=True).count() == 2500


@pytest.mark.parametrize("text", ["", "x"])
def test_no_timed_lines(spark, text):
    assert spark.range(1).select(R.timed_lines(F.lit(text)).alias("x")).first()["x"] == []
