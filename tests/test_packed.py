"""Packed token files: round trips, ranges, and failures at every step."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import sequences as S
from loomline.sources import packed as P


@pytest.fixture
def docs(spark):
    rows = [(k % 3, k, [65 + j for j in range(k % 4)], [j * 7 % 1024 for j in range(k)]) for k in range(40)]
    x = spark.createDataFrame(rows, "shard int, k long, text array<int>, codes array<int>")
    return x.select("shard", "k", S.song_document(F.col("text"), F.col("codes")).alias("tokens")).repartition(5)


def test_round_trip_and_layout(spark, docs, tmp_path):
    path = str(tmp_path / "p")
    P.write_packed_files(docs, "tokens", "shard", ["k"], path)
    want = {(r.shard, (r.k - r.shard) // 3): r.tokens for r in docs.collect()}
    got = P.read_packed_files(spark, path, documents="3")
    assert got.rdd.getNumPartitions() == sum(-(-n // 3) for n in (14, 13, 13))
    rows = got.orderBy("shard", "ord").collect()
    assert {(r.shard, r.ord): r.tokens for r in rows} == want
    for a, b in zip(rows, rows[1:], strict=False):
        assert b["at"] == (a["at"] + a["size"] if a.shard == b.shard else 0)
    meta = P.manifest(path)["shards"]
    flat = np.fromfile(f"{path}/{meta[1]['file']}.bin", "<i4")
    assert flat.tolist() == [t for (s, _), x in sorted(want.items()) if s == 1 for t in x] and len(flat) == meta[1]["tokens"]
    raw = open(f"{path}/{meta[1]['file']}.idx", "rb").read()
    assert raw[:9] == b"MMIDIDX\x00\x00" and len(raw) == 34 + 4 * 13 + 8 * 13 + 8 * 14
    assert all(r.ok for r in P.verify_files(spark, path).collect())


def test_ranges_are_pruned(spark, docs, tmp_path):
    path = str(tmp_path / "p")
    P.write_packed_files(docs, "tokens", "shard", ["k"], path)
    reader = P.PackedReader(path, 3, False)
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    left = list(reader.pushFilters([EqualTo(("shard",), 2), GreaterThanOrEqual(("ord",), 4), LessThan(("ord",), 9), In(("size",), (1, 2))]))
    assert [type(x) for x in left] == [In]
    assert [(p.shard, p.low, p.high) for p in reader.partitions()] == [(2, 4, 7), (2, 7, 9)]
    got = P.read_packed_files(spark, path, documents="3").where("shard = 2 and ord >= 4 and ord < 9 and size > 0")
    assert sorted(r.ord for r in got.collect()) == [4, 5, 6, 7, 8] and got.rdd.getNumPartitions() == 2


def test_first_middle_and_last(spark, docs, tmp_path):
    path = str(tmp_path / "p")
    P.write_packed_files(docs, "tokens", "shard", ["k"], path)
    rows = P.checked_ends(spark, path).orderBy("shard", "ord").collect()
    assert [(r.shard, r.ord) for r in rows] == [(0, 0), (0, 7), (0, 13), (1, 0), (1, 6), (1, 12), (2, 0), (2, 6), (2, 12)]
    assert all(r.ctrl == [S.EOD, S.SOA, S.CODEC_A] and r.tail == [S.EOA, 0] for r in rows)
    last = rows[-1]  # k = 38
    assert (last.len, last.n_text, last.first_codes) == (38 + 2 + 5, 2, [0, 7, 14, 21, 28])


def test_a_failed_task_shows_nothing(spark, docs, tmp_path):
    path = str(tmp_path / "p")
    broken = docs.withColumn("tokens", F.when(F.col("k") == 17, F.lit(None)).otherwise(F.col("tokens")))
    with pytest.raises(Exception, match="no tokens"):
        P.write_packed_files(broken, "tokens", "shard", ["k"], path)
    assert P.manifest(path) is None and not [f for f in os.listdir(path) if f.endswith((".bin", ".idx"))]
    with pytest.raises(Exception, match="no complete packed token files"):
        P.read_packed_files(spark, path).count()
    P.write_packed_files(docs, "tokens", "shard", ["k"], path)
    before = sorted(map(tuple, P.read_packed_files(spark, path).select("shard", "ord", "size").collect()))
    with pytest.raises(Exception, match="no tokens"):
        P.write_packed_files(broken, "tokens", "shard", ["k"], path, mode="overwrite")
    assert sorted(map(tuple, P.read_packed_files(spark, path).select("shard", "ord", "size").collect())) == before


def test_appends_overwrites_and_clashes(spark, docs, tmp_path):
    path = str(tmp_path / "p")
    P.write_packed_files(docs.where("shard < 2"), "tokens", "shard", ["k"], path)
    P.write_packed_files(docs.where("shard = 2"), "tokens", "shard", ["k"], path)
    assert P.read_packed_files(spark, path).count() == 40
    with pytest.raises(Exception, match="there already"):
        P.write_packed_files(docs.where("shard = 1"), "tokens", "shard", ["k"], path)
    with pytest.raises(Exception, match="two tasks|one piece"):
        docs.select("shard", "tokens").repartition(4).write.format("packed_tokens").mode("append").save(path)
    assert P.read_packed_files(spark, path).count() == 40
    P.write_packed_files(docs.where("shard = 1"), "tokens", "shard", ["k"], path, mode="overwrite")
    assert P.read_packed_files(spark, path).count() == 13 and len(os.listdir(path)) == 3


def test_empty_documents_tables_and_damage(spark, docs, tmp_path):
    path = str(tmp_path / "p")
    some = spark.createDataFrame([(0, 0, []), (0, 1, [5]), (0, 2, []), (7, 0, [])], "shard int, k long, tokens array<int>")
    P.write_packed_files(some, "tokens", "shard", ["k"], path)
    assert sorted(map(tuple, P.read_packed_files(spark, path).select("shard", "ord", "at", "tokens").collect())) == [(0, 0, 0, []), (0, 1, 0, [5]), (0, 2, 1, []), (7, 0, 0, [])]
    P.write_packed_files(some.limit(0), "tokens", "shard", ["k"], str(tmp_path / "none"))
    assert P.read_packed_files(spark, str(tmp_path / "none")).count() == 0
    file = P.manifest(path)["shards"][0]["file"]
    with open(f"{path}/{file}.bin", "r+b") as f:
        f.write(b"\x09")
    assert {r.shard: r.ok for r in P.verify_files(spark, path).collect()} == {0: False, 7: True}
    with pytest.raises(Exception, match="no shard"):
        P.write_packed_files(some.withColumn("shard", F.lit(None).cast("int")), "tokens", "shard", ["k"], str(tmp_path / "x"))
