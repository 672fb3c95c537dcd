"""Operators on small literal inputs with expected values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from loomline.functions import cleaning, vectors
from loomline.functions import text as T
from loomline.operators import aggregates as A
from loomline.operators import filters as P
from loomline.operators import sampling as O
from loomline.operators import sequences as S
from loomline.operators import windows as W


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, F.lit(1).__class__) else v.alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def ints(*x):
    return F.array(*[F.lit(i) for i in x]).cast("array<int>")


def test_text_normal_forms(spark):
    f = lambda fn, v: one(spark, fn(F.col("v")), v=F.lit(v))
    assert f(T.norm_title, "My Song (Live at X) - B!") == "mysongb"
    assert f(T.norm_letters, "a_É日 b") == "aé日b"
    assert f(T.norm_wer, "Hello, (oh) [x] WORLD 你好") == "hello world 你 好"
    assert f(T.is_instrumental, "[verse]\n[chorus]") is True
    assert f(T.script_of, "привет мир") == "cyrillic" and f(T.script_of, "123") == "none" and f(T.script_of, "日本語 abc") == "cjk"
    assert f(T.script_majority, "abпр") == "latin" and f(T.script_majority, "") == "none" and f(T.script_majority, "12") == "other" and f(T.script_majority, "你好a") == "cjk"
    assert f(T.caption_language, "あ" * 21) == "japanese" and f(T.caption_language, "한" * 21) == "korean" and f(T.caption_language, "你好你好 abcdefgh") == "mandarin, english"
    assert f(T.iso_language, "한국어 노래") == "kor" and f(T.iso_language, "きみの歌") == "jpn" and f(T.iso_language, "我哋嘅歌") == "yue" and f(T.iso_language, "我们的歌") == "cmn" and f(T.iso_language, "song") == "und" and f(T.iso_language, "1") == ""
    assert f(T.sung_units, "你好 hello rhythm") == 5
    assert f(T.all_below, "Ünï") is True and f(T.all_below, "你") is False
    assert f(T.tags, "pop, rock;; jazz/") == ["pop", "rock", "jazz"] and f(T.first_artist, "Ann & Bo") == "ann" and f(T.markers, "[a]x[b c]") == ["a", "b c"]
    assert f(T.html_escape, "<a>&'\"") == "&lt;a&gt;&amp;&#x27;&quot;" and f(T.slug, "Ab, c!") == "ab-c" and f(T.safe_id, "../x") is False
    assert f(T.without_db, "louder -3.5 dB now") == "louder now"
    assert f(T.letters_encoded, "ab z") == [1, 2, 0, 26]
    assert one(spark, T.timestamp(F.col("v")), v=F.lit(75.25)) == "[01:15.2]"
    assert one(spark, T.bucket_closed(F.lit("abc"))) == 2416005272 / 4294967295
    assert one(spark, T.prompt_text(F.lit(" pop "), F.lit("la\n"))) == "[Genre] pop\n[Lyrics]\nla\n"
    assert one(spark, T.chat_prompt([("title", F.lit("x")), ("style", F.lit(""))])) == "User: title: x\n\nAssistant: <think></think>"
    assert one(spark, T.keep_tail(ints(1, 2, 3, 4, 5), 3, 1)) == [1, 4, 5]


@pytest.mark.parametrize(
    ("line", "text", "rule"),
    [
        ("版权所有 侵权必究", "", "notice"), ("see www.x.org", "", "notice"), ("Verse 2", "", "section"), ("Chorus: la la", "", "section"), ("（男）你好", "你好", "singer"), ("心（こころ）", "こころ", "furigana"),
        ("作曲：某某", "", "credit"), ("小明：你好啊", "你好啊", "role"), ("love you / 我爱你", "love you", "split"), ("love you (我爱你)", "love you", "paren"), ("听 Jazz（爵士）吧", "听 Jazz吧", "gloss"), ("사랑 爱 해", "사랑 해", "korean"), ("  plain   line ", "plain line", None), ("Time: goes by", "Time: goes by", None),
    ],
)
def test_clean_line(spark, line, text, rule):
    got = one(spark, cleaning.clean_line(F.col("v")), v=F.lit(line))
    assert (got["text"], got["rule"]) == (text, rule)


def test_clean_lines_title_and_trailing(spark):
    df = spark.createDataFrame([(["My Song", "hello there 我在这里", "good day 你好吗", "作词: X", "end"], "my-song")], "x array<string>, t string")
    assert cleaning.clean_lines(df, "x", F.col("t")).first()["x"] == ["hello there", "good day", "end"]


def test_sequences(spark):
    assert one(spark, S.song_document(ints(9), ints(0, 3))) == [9, 65536, 65537, 65539, 65544, 65547, 65538, 0]
    assert S.fsq_basis([8, 8, 8, 6, 5]) == [1, 8, 64, 512, 3072] and math.prod([8, 8, 8, 6, 5]) == 15360
    assert one(spark, S.fsq_index("v", [8, 8, 8, 6, 5]), v=ints(7, 7, 7, 5, 4)) == 15359
    assert one(spark, S.fsq_quantise("v", [5, 3]), v=F.array(F.lit(-2.0), F.lit(0.25))) == [0, 1]
    assert one(spark, W.collapsed("v"), v=ints(1, 1, 0, 1, 2, 2, 0)) == [1, 1, 2]
    assert [tuple(r) for r in one(spark, W.cursors("v", 3, 4), v=ints(0, 1, 5, 9))] == [(0, 2), (2, 1), (3, 1)]
    assert one(spark, W.id_window("v", F.lit(0), 1, 3, -1, -2), v=ints(5, 6)) == [-1, 5, 6, -2]
    assert one(spark, S.interleave("v"), v=F.array(ints(1, 2), ints(3, 4))) == [1, 3, 2, 4] and one(spark, S.deinterleave("v", 2), v=ints(1, 3, 2, 4)) == [[1, 2], [3, 4]]
    assert one(spark, S.with_offsets("v"), v=F.array(ints(1), ints(2))) == [[1], [1026]]
    assert one(spark, S.mode_imputed("v", 0, 9), v=ints(4, 4, 99, 2)) == [4, 4, 4, 2]
    assert one(spark, S.position_tags("v", 1), v=ints(7, 65536, 65541, 5, 65537, 65540, 65544, 65545, 65538, 0)) == ["b", "b", "t", "b", "b", "c0", "c", "b", "b"]


def test_interleaved_goldens(spark):
    def lines(*x):
        return F.array(*[F.struct(F.lit(a).alias("at"), ints(*i).alias("ids")) for a, i in x])

    got = one(spark, W.interleaved("v", 6, 100), v=lines((0, [5, 6]), (3, [7])))
    assert [r["kind"] for r in got] == [1, 1, 1, 0, 0, 0, 1, 1, 0, 0, 0] and [r["frame"] for r in got] == [-1, -1, -1, 0, 1, 2, -1, -1, 3, 4, 5] and [r["letter"] for r in got] == [5, 6, 1, 0, 0, 0, 7, 1, 0, 0, 0]
    got = one(spark, W.interleaved("v", 6, 100), v=lines((-3, [5]), (3, [7]), (0, [6])))
    assert [r["kind"] for r in got] == [1, 1, 1, 1, 0, 0, 0, 1, 1, 0, 0, 0] and [r["letter"] for r in got] == [5, 1, 6, 1, 0, 0, 0, 7, 1, 0, 0, 0]
    assert [r["letter"] for r in one(spark, W.interleaved("v", 2, 3), v=lines((0, [5, 6]), (1, [7])))] == [5, 6, 1, 0, 0]


def test_folds(spark):
    rows = spark.createDataFrame([(1, 4.0 * k, 4.0 * k + 4) for k in range(7)], "g int, a double, b double")
    assert [r.n for r in W.bounded_sessions(rows, "g", "a", "b").orderBy("k").collect()] == [5, 2]
    cuts = one(spark, W.cut_points("v", F.lit(70.0)), v=F.array(*[F.lit(x) for x in (10.0, 20.0, 28.0, 50.0)]))
    assert [tuple(c) for c in cuts] == [(0.0, 28.0), (28.0, 50.0), (50.0, 70.0)]
    seg = lambda *x: F.array(*[F.struct(F.lit(t).alias("text"), F.lit(a).alias("f0"), F.lit(b).alias("f1")) for t, a, b in x])
    merged = one(spark, W.merge_short("v", 25), v=seg(("a", 0, 30), ("b", 30, 40), ("c", 40, 90), ("d", 90, 95)))
    assert [tuple(m) for m in merged] == [("a", 0, 30), ("bcd", 30, 95)]
    s = spark.createDataFrame([(1, 0, 1.0, 2.0, 10.0), (1, 1, None, None, 10.0), (1, 2, 8.0, 9.0, 10.0)], "g int, k int, a double, e double, d double")
    assert [r.b for r in W.boundaries(s, "g", "k", "a", "e", "d").orderBy("k").collect()] == [0.0, 2.5, 7.5]
    assert [tuple(x) for x in one(spark, W.half_windows(F.lit(10), 4))] == [(0, 0, 3), (2, 3, 5), (4, 5, 7), (6, 7, 10)]


def test_quantiles_and_weights(spark):
    df = spark.createDataFrame([("g", v) for v in range(1, 11)], "k string, v int")
    assert A.nearest_rank(df, "k", "v", {"m": 0.5}).first()["m"] == 6
    four = spark.createDataFrame([(v,) for v in (1, 2, 3, 10)], "v int")
    assert abs(four.agg(A.linear_percentile("v", 0.95)).first()[0] - 8.95) < 1e-9
    cats = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "v string")
    assert A.entropy(cats, "v").first()["bits"] == 1.5
    songs = spark.range(600).select(F.lit("x").alias("artist"), (F.col("id") % 12).alias("album"))
    assert O.group_weights(songs, {"artist": 300, "album": 100}).first()["w"] == 0.5
    p = spark.createDataFrame([(1, k, v) for k, v in enumerate((0.5, 0.3, 0.15, 0.05))], "g int, s int, p double")
    assert sorted(r.s for r in W.nucleus(p, "g", "s", "p", 0.75).collect()) == [0, 1]
    assert spark.range(1).select(F.bround(F.lit(0.5)), F.bround(F.lit(1.5)), F.bround(F.lit(2.5))).first()[:] == (0, 2, 2)
    assert O.magic_prime(1000) == 983
    draws = O.weighted(spark.createDataFrame([("g", 1, 1.0), ("g", 2, 3.0)], "g string, i int, w double"), "g", "i", "w", 2000)
    assert 0.7 < draws.agg(F.avg((F.col("i") == 2).cast("double"))).first()[0] < 0.8 and draws.count() == 2000


def test_error_rates_and_vectors(spark):
    df = spark.createDataFrame([("kitten sat", "sitting sat"), ("", "a b"), ("a", "")], "h string, r string")
    got = df.select(vectors.letter_error(F.col("h"), F.col("r")).alias("c"), vectors.wer(vectors.words_of(F.col("h")), vectors.words_of(F.col("r"))).alias("w"), vectors.wer_strict(vectors.words_of(F.col("h")), vectors.words_of(F.col("r"))).alias("s")).collect()
    assert got[0].c == 0.3 and got[0].w == 0.5 and math.isnan(got[1].w) and got[1].s == 1.0 and math.isnan(got[2].s)
    assert df.limit(1).select(vectors.romanised(F.lit("Été Ñandú 日"))).first()[0] == "ete nandu"
    assert abs(one(spark, vectors.cosine("a", "b"), a=ints(1, 0), b=ints(1, 1)) - 0.5**0.5) < 1e-12
    assert one(spark, vectors.beat_stability("a"), a=F.array(*[F.lit(float(x)) for x in (0, 1, 2, 3)])) == 1.0


def test_flags_and_checks(spark):
    t = lambda a, b: F.struct(F.lit(a).alias("t0"), F.lit(b).alias("t1n"), F.lit("la").alias("text"))
    got = one(spark, P.timing_flags("v", F.lit(100.0), T.sung_units), v=F.array(t(0.0, 0.01), t(1.0, 1.02), t(2.0, 2.05), t(3.0, 3.01), t(120.0, 120.5)))
    assert got == ["lyr_after_end", "lyr_zero", "lyr_fast"] or got == ["lyr_after_end", "lyr_zero"]
    with pytest.raises(Exception, match="more than once"):
        P.unique_or_raise(spark.createDataFrame([(1,), (1,)], "k int"), "k").collect()
