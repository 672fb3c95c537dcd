"""Prompts, directives, accuracies, level use, lyric files by hand, and passes of shards, on literals."""

import json

import pytest
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.functions import vectors as V
from loomline.operators import aggregates as A
from loomline.operators import alignment as L
from loomline.operators import filters as P
from loomline.sources import readers as R
from loomline.streaming import ingest


def one(spark, column, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()], F.lit(0).alias("__0")).select(column.alias("x")).first()["x"]


def test_prompts_stop_at_the_first_line_that_does_not_fit(spark):
    lines = F.array(*[F.struct(F.lit(float(k)).alias("t0"), F.lit(t).alias("text")) for k, t in enumerate(("a  b", "x" * 60, "c"))])
    make = lambda **k: one(spark, T.song_prompt(F.lit("Make\na song."), {"title": F.lit(" T "), "album": F.lit(None).cast("string")}, F.lit(True), F.lit(12.25), lines, **k))
    head = "User: Make a song.\ntitle: T\nis_live: true\ndur: 12.2\nlines:"
    assert make() == f"{head}\n[00:00.0] a b\n[00:01.0] {'x' * 60}\n[00:02.0] c\n\n{T.THINK}"
    assert make(most=len(head) + 20) == f"{head}\n[00:00.0] a b\n\n{T.THINK}"
    assert make(most=len(head) + 4, times=False) == f"{head}\na b\n\n{T.THINK}" and make(most=10) == f"{head}\n\n{T.THINK}"
    none = one(spark, T.song_prompt(F.lit("Go"), {}, F.lit(None).cast("boolean"), F.lit(None).cast("double"), F.lit(None).cast("array<struct<t0:double,text:string>>")))
    assert none == f"User: Go\n\n{T.THINK}"
    assert [one(spark, T.request_text(F.lit(v).cast("string"))) for v in ("deu", "xx", None)] == ["Mach ein Lied.", "Make a song.", "Make a song."]
    assert one(spark, T.one_line(F.lit("  a \n b  "), 2)) == "a "


def test_directives_and_targets(spark):
    s = F.array(*[F.struct(F.lit(float(a)).alias("start"), F.lit(float(b)).alias("end"), F.lit(d).cast("string").alias("directive")) for a, b, d in ((0, 5, ""), (0, 9, "soft"), (5, 9, "loud"), (9, 10, None))])
    assert [one(spark, T.directive_at(s, F.lit(v))) for v in (0.0, 8.4, 8.5, 9.0)] == ["soft", "soft", "", ""]
    m = F.create_map(F.lit(1), F.lit("x"))
    assert [one(spark, T.directive_of(m, F.lit(k))) for k in (1, 2)] == ["x", ""]
    ints = lambda *x: F.array(*map(F.lit, x)).cast("array<int>")
    assert one(spark, T.lyric_targets(ints(92, 5, 94, 11, 6, 7, 11))) == [6, 7] and one(spark, T.lyric_targets(ints(6, 94, 11))) == [6, 94] and one(spark, T.lyric_targets(ints(92, 6))) == [92, 6]


def test_lyric_files_by_hand(spark):
    got = one(spark, R.user_lyrics(F.lit("[0:01.5] la \n\nplain\n[Chorus]\n[1:02]\n[x] y\r\n [02:03.25]b")))
    assert [tuple(r) for r in got] == [(1.5, "la"), (None, "plain"), (123.25, "b")]


def test_accuracies_levels_and_norms(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.3], 1), ([0.9, 0.1, 0.3], 2), ([0.9, 0.1, 0.3], 1), ([0.0, 0.0, 1.0], -100)], "s array<double>, y int")
    near = spark.createDataFrame([(1, [2]), (2, [0])], "target int, near array<int>")
    r = L.masked_accuracy(df, "s", "y", near).first()
    assert (round(r.top1, 4), r.top5, round(r.near, 4)) == (0.3333, 1.0, 0.6667)
    assert [L.dims_for([5, 4, 0.5, 0.5], p) for p in (0.5, 0.9, 0.95, 1.0)] == [1, 2, 3, 4]
    x = spark.createDataFrame([([-1.0, 0.0],), ([0.99, 0.4],), ([0.1, 0.99],)], "v array<double>")
    got = {(r.dim, r.level): (r.n, round(r.share, 4), round(r.saturated, 4)) for r in A.level_usage(x, "v", [3, 4]).collect()}
    assert got == {(0, 0): (1, 0.3333, 0.6667), (0, 1): (1, 0.3333, 0.6667), (0, 2): (1, 0.3333, 0.6667), (1, 2): (2, 0.6667, 0.3333), (1, 3): (1, 0.3333, 0.3333)}
    n = one(spark, V.instance_normalised(F.array(*map(F.lit, (1.0, 2.0, 3.0)))))
    assert [round(v, 3) for v in n] == [-1.0, 0.0, 1.0] and one(spark, V.instance_normalised(F.array(F.lit(4.0)))) == [0.0]


def test_predicates_and_columns(spark):
    assert [one(spark, P.good_word_times(F.lit(n), F.lit(u))) for n, u in ((4, 0), (3, 0), (10, 2), (10, 3))] == [True, False, True, False]
    df = spark.createDataFrame([("timed", [1]), (None, [1]), ("", []), (None, None)], "kind string, lines array<int>")
    assert P.present(df, ["x", "lines", "kind"]).columns == ["lines", "kind"]
    assert [r.k for r in df.select(P.kind_of_lyrics(F.col("kind"), F.col("lines")).alias("k")).collect()] == ["timed", "timed", "none", "none"]


@pytest.mark.parametrize("flush", [False, True])
def test_passes_of_whole_shards(spark, tmp_path, flush):
    (tmp_path / "in").mkdir()
    put = lambda name, ids: (tmp_path / "in" / name).write_text("".join(json.dumps({"i": i}) + "\n" for i in ids))
    run = lambda f=False: ingest.shard_pass(spark, str(tmp_path / "in"), "i long", str(tmp_path / "out"), str(tmp_path / "cp"), "i", 10, f)
    held = lambda: sorted(r.i for r in ingest.read_shards(spark, str(tmp_path / "out")).collect())
    put("1.json", [*range(0, 14), 25])
    run()
    assert held() == list(range(10))
    put("2.json", range(14, 22))
    run()
    assert held() == list(range(20))
    put("3.json", [22])
    run(flush)
    assert held() == (list(range(23)) + [25] if flush else list(range(20)))
    rest = spark.read.parquet(f"{tmp_path}/out/rest/batch=2")
    assert sorted(r.i for r in rest.collect()) == ([] if flush else [20, 21, 22, 25])


def test_word_edits_by_dynamic_programming(spark):
    import random

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    rng = random.Random(1)
    rows = [([f"w{rng.randrange(n)}" for _ in range(rng.randint(0, n))], [f"w{rng.randrange(n)}" for _ in range(rng.randint(0, n))]) for n in (3, 10, 400, 900) for _ in range(4)] + [([], []), (None, ["a"]), (["é", "日本"], ["日本"])]
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a array<string>, b array<string>").select("k", V.word_edits(F.col("a"), F.col("b")).alias("e")).collect()
    assert {r.k: r.e for r in got} == {k: None if a is None else plain(a, b) for k, (a, b) in enumerate(rows)}
