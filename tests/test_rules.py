"""Rule counters of the cleaner, the second cleaner, and plans that must not grow."""

import time

from pyspark.sql import functions as F

from loomline.functions import cleaning as C
from loomline.operators import aggregates as A
from loomline.operators import joins as J
from loomline.operators import sampling as O
from loomline.operators import sequences as S
from loomline.operators import windows as W


def test_counters_of_every_rule(spark):
    lines = ["Song - Artist", "作词：某人", "未经许可不得翻唱", "[Chorus]", "(男) 你好吗", "心（こころ）が", "小明：爱你", "hello 你好世界 / 你好", "good day (美好的一天)", "사랑해 我爱你", " two  words ", "fine"]
    df = spark.createDataFrame([(lines, "song"), ([], "x"), (["plain words", "more"], "")], "x array<string>, t string")
    got = C.clean_report(df, "x", F.col("t")).collect()
    counts = {k: v for k, v in got[0]["counts"].items() if v}
    assert counts.pop("title") == 1 and counts["notice"] == 1 and counts["credit"] == 1 and counts["singer"] == 1 and counts["furigana"] == 1 and counts["role"] == 1 and counts["paren"] == 1 and counts["korean"] == 1
    assert counts["dropped_lines"] == 3 and len(got[0]["x"]) == len(lines) - 1 - 3 and counts["lines_changed"] >= 6
    assert got[1]["x"] == [] and sum(got[1]["counts"].values()) == 0
    assert got[2]["x"] == ["plain words", "more"] and not sum(got[2]["counts"].values()) and sorted(got[2]["counts"]) == sorted(C.RULES)


def test_trailing_translations_count(spark):
    df = spark.createDataFrame([(["hello there 你好你好", "good day 美好的一天", "end"],)], "x array<string>")
    r = C.clean_report(df, "x", F.lit("")).first()
    assert r["x"] == ["hello there", "good day", "end"] and r["counts"]["trailing"] == 2


def test_sung_text(spark):
    cases = {"编曲 : 某某": None, "Vocal Producer: X": None, "合：大家唱": "大家唱", "A+B： la la": "la la", "Hook:": None, "版权所有": None, "【未经许可】": None, "a very long label here: text": "a very long label here: text", "plain": "plain", "": "", "小明: hi ": "hi"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.s for r in df.select("t", C.sung_text(F.col("t")).alias("s")).collect()} == cases


def test_long_documents_are_tagged_in_linear_time(spark):
    doc = [7, S.EOD] + ([S.SOS, 5, 6, S.SOA, S.CODEC_B] + [S.CODE_BASE + k % 9 for k in range(1995)] + [S.EOA]) * 8 + [0]
    df = spark.createDataFrame([(doc,)], "v array<int>").repartition(1).cache()
    df.count()
    df.select(S.position_tags("v")).collect()
    began = time.time()
    tags = df.select(S.position_tags("v").alias("t")).first()["t"]
    assert time.time() - began < 2 and len(tags) == len(doc) - 1 == 16_010
    n, want = 0, []
    for v in doc:
        n = 0 if v in (S.SOA, S.SOS, S.EOA, S.EOD) else n + 1 if v >= S.CODE_BASE else n
        want.append(("c0" if n <= 50 else "c") if v >= S.CODE_BASE else "b" if v >= S.EOD or v == 0 else "t")
    assert tags == want[1:]


def test_sessions_of_a_large_group(spark):
    df = spark.range(200_000).select(F.lit("g").alias("g"), (F.col("id") * 2.0).alias("a"), (F.col("id") * 2.0 + 1).alias("b"))
    began = time.time()
    r = W.bounded_sessions(df, "g", "a", "b").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.max("n").alias("m")).first()
    assert (r.n, r.m, r.k) == (200_000, 6, -(-200_000 // 6)) and time.time() - began < 20
    some = spark.createDataFrame([(None, 0.0, 1.0), (None, 1.5, 2.0), ("x", None, 1.0), ("x", 3.0, 4.0)], "g string, a double, b double")
    assert sorted((tuple(r) for r in W.bounded_sessions(some, "g", "a", "b").collect()), key=str) == sorted([(None, 0, 0.0, 2.0, 2), ("x", 0, 3.0, 4.0, 1)], key=str)


def test_ranks_and_cut_points_by_sorting(spark):
    import statistics

    rows = [(g, (k * k * 7 + g) % 23) for g in range(4) for k in range([1, 2, 50, 301][g])]
    df = spark.createDataFrame(rows, "g int, v int")
    near = {r.g: (r.p5, r.p9) for r in A.nearest_rank(df, "g", "v", {"p5": 0.5, "p9": 0.9}).collect()}
    cuts = {}
    for r in A.exclusive_quantiles(df, "g", "v", 10).collect():
        cuts.setdefault(r.g, {})[r.k] = r.v
    for g in range(4):
        x = sorted(v for h, v in rows if h == g)
        assert near[g] == tuple(x[min(len(x) - 1, int(p * len(x)))] for p in (0.5, 0.9))
        if len(x) > 1:
            assert [round(cuts[g][k], 9) for k in range(1, 10)] == [round(v, 9) for v in statistics.quantiles(x, n=10)]
    assert 0 not in cuts


def test_samples_in_parts(spark):
    df = spark.range(5000).select("id", (F.col("id") % 10 == 0).alias("s"))
    assert sorted(r.id for r in O.stratified(df, "s", "id", 100, 1).collect()) == sorted(r.id for r in O.stratified(df, "s", "id", 100, 64).collect())
    w = spark.range(100).select(F.lit("g").alias("g"), "id", (F.col("id") % 7).cast("double").alias("w"))
    one, many = ({(r.draw, r.id) for r in O.weighted(w, "g", "id", "w", 500, bins=b).collect()} for b in (1, 1024))
    assert one == many and len(many) == 500 and not {i for _, i in many if i % 7 == 0}


def test_bucketed_tables_join_without_a_shuffle(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        arrays = J.bucketed(spark.range(300).select("id", F.array("id", F.col("id") + 1).alias("x")), "t_arrays", "id", 4)
        meta = J.bucketed(spark.range(0, 300, 3).withColumn("m", F.col("id") * 2), "t_meta", "id", 4)
        df = J.partition_wise(meta, arrays, "id")
        assert df.count() == 100
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        for t in ("t_arrays", "t_meta"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_means_by_position(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (1, [10.0]), (1, []), (1, None), (2, [1.0, 1.0, 7.0])], "k int, v array<double>")
    got = {(r.k, r.part): (r["mean"], r.n, r.rows) for r in A.position_means(df, "v", ["k"], 2, 2).collect()}
    assert got == {(1, "first"): (5.75, 3, 2), (1, "last"): (7.25, 3, 2), (1, "mid"): (3.0, 1, 1), (1, "from 0"): (5.75, 3, 2), (1, "from 2"): (3.5, 2, 1), (1, "from 4"): (5.0, 1, 1), (2, "first"): (1.0, 2, 1), (2, "last"): (4.0, 2, 1), (2, "from 0"): (1.0, 2, 1), (2, "from 2"): (7.0, 1, 1)}


def test_paired_metrics_keep_null_nan_and_absent_apart(spark):
    nan = float("nan")
    a = spark.createDataFrame([(1, {"x": 1.0, "y": None, "z": 2.0}), (2, {"x": 4.0}), (3, {"x": nan})], "i int, m map<string,double>")
    b = spark.createDataFrame([(1, {"x": 3.0, "y": 1.0}), (2, {"x": 5.0}), (3, {"x": 1.0}), (4, {"w": 1.0})], "i int, m map<string,double>")
    pairs = A.paired_metrics(a, b, "i", "m")
    assert sorted((r.i, r.metric, r.state) for r in pairs.collect()) == [(1, "x", "both"), (1, "y", "null"), (1, "z", "only_a"), (2, "x", "both"), (3, "x", "nan"), (4, "w", "only_b")]
    x = {r.metric: r for r in A.paired_summary(pairs).collect()}["x"]
    assert (x.n, x.mean_a, x.median_b, x.median_diff, x.worse, x.nan) == (2, 2.5, 4.0, 1.5, 2, 1)
    assert {r.key: (r["mean"], r.n) for r in A.mean_by_key(a, "m").collect()} == {"x": (2.5, 2), "y": (None, 0), "z": (2.0, 1)}
