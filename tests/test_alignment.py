"""Alignment and judging operators on literal inputs."""

from pyspark.sql import functions as F

from loomline.operators import alignment as G


def test_matching_words(spark):
    df = spark.createDataFrame([(1, "a b c d".split(), "a x c d".split())], "k int, a array<string>, b array<string>")
    assert sorted((r.i, r.j, r.word) for r in G.matched_words(df, "a", "b", ["k"]).collect()) == [(0, 0, "a"), (2, 2, "c"), (3, 3, "d")]
    assert df.select(G.zipped_lines("a", "b").alias("z")).first()["z"][1]["aligned"] == "x"
    assert df.withColumn("c", F.slice("a", 1, 2)).select(G.zipped_lines("a", "c").alias("z")).first()["z"] is None


def test_ranks(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.2], 1), ([0.1, 0.7, 0.2], 0)], "s array<double>, t int")
    r = G.top_accuracy(df, "s", "t", (1, 3)).first()
    assert (r.top1, r.top3) == (0.5, 1.0)


def test_key_and_centroids(spark):
    g_major = [float(G.MAJOR[(i - 7) % 12]) for i in range(12)]
    df = spark.createDataFrame([(1, g_major)], "k int, c array<double>")
    r = G.key_estimate(df, "c", ["k"]).first()
    assert r.key == "G major" and r.key_conf > 0
    pts = spark.createDataFrame([([0.0, 0.1],), ([5.0, 5.1],), ([0.1, 0.0],), ([5.1, 5.0],)], "v array<double>")
    assert [r.n for r in G.nearest_centroid(pts, "v", [[0.0, 0.0], [5.0, 5.0]], "n").collect()] == [0, 1, 0, 1]
    assert len(G.centroids(pts, "v", 2)) == 2 and G.spectrum(pts, "v", 1)[0] > 0.99


def test_frames_and_replies(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [1.0, 0.0], [-1.0, 0.0], [-1.0, 0.0]],)], "f array<array<double>>")
    assert abs(df.select(G.lag_cosine("f").alias("x")).first()["x"] - 1 / 3) < 1e-9
    replies = spark.createDataFrame([('sure: {"tags": "x", "s": {"a": "1"}} ok', 2), ('{"tags": "x", "s": {}}', 2), ("none", 1)], "r string, n int")
    got = [r.x for r in replies.select(G.valid_reply(F.col("r"), "tags string, s map<string,string>", "s", F.col("n")).alias("x")).collect()]
    assert got[0]["s"] == {"a": "1"} and got[1] is None and got[2] is None
    assert spark.range(1).select(G.unknown_keys(F.lit('{"a":1,"b":2}'), ["a"]).alias("x")).first()["x"] == ["b"]
