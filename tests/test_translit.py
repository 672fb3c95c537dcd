"""Romanised words, script by script, and the clean index by plain rules."""

import pytest
from pyspark.sql import functions as F

from loomline.functions.translit import romanised_rows, romanised_words, table
from loomline.operators import clean_index as X

CASES = {
    "Crème Brûlée Straße øre": "creme brulee strasse ore", "Don’t `stop'": "don't 'stop'", "きゃりー ぱみゅぱみゅ": "kyari pamyupamyu", "がっこう いっぱい マッチ ざっし": "gakkou ippai matchi zasshi", "しんじゃう ふじ つづく": "shinjau fuji tsuzuku",
    "ｶﾗｵｹ": "karaoke", "Щука ёлка объём": "shchuka yolka obyom", "Київ": "kyyiv", "한국어 사랑해 값": "hangukeo saranghae kap", "東京 abc": " abc", "123 a1b": " ab", "é": "e",
}


def test_scripts(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "t string")
    got = {r.t: [tuple(w) for w in r.w] for r in df.select("t", romanised_words(F.col("t")).alias("w")).collect()}
    want = {"Київ": "kiyiv", "한국어 사랑해 값": "hangukeo saranghae gap"}
    for text, roman in (CASES | want).items():
        assert " ".join(w[2] for w in got[text]) == roman, text
        assert [w[0] for w in got[text]] == list(range(len(got[text]))) and [w[1] for w in got[text]] == text.split()
    assert spark.createDataFrame([(None,)], "t string").select(romanised_words(F.col("t")).alias("w")).first()["w"] is None
    assert len(table()) > 300


def test_pluggable_readings(spark):
    df = spark.createDataFrame([("東京都 京",)], "t string")
    assert [w.roman for w in df.select(romanised_words(F.col("t"), {"東京": "tokyo", "京": "kyo", "都": "to"}).alias("w")).first()["w"]] == ["tokyoto", "kyo"]


SONGS = "id long, source string, audio_path string, title string, artists string, album string, duration double, sr int, lyric_kind string, is_live boolean, n_lines int"
ROWS = [
    (1, "yt", "a/1.mp3", "Night Song", "Ann, Bo", "One", 200.0, 44100, "timed", False, 9), (2, "ne", "a/2.flac", "night song", "ann", "One", 201.5, 48000, "timed", False, 9), (3, "ne", "a/3.mp3", "Night Song", "Ann", "one ", 203.6, None, "untimed", False, 0),
    (4, "ne", "a/4.mp3", "Night Song", "Ann", "", 202.0, None, "timed", True, 9), (5, "ne", "a/5.mp3", "Karaoke of all", "Cy", None, 90.0, None, "timed", False, 3), (6, "xx", "a/6.wav", "White Noise", None, None, 700.0, None, "none", False, 0),
    (7, "sd", "a/7.mp3", None, None, None, 20.0, None, "none", None, 0), (8, "sd", "a/8.mp3", "Other", "Dee", None, 100.0, None, "timed", False, 5),
]


@pytest.fixture
def index(spark):
    scans = spark.createDataFrame([("a/1.mp3", 1, None, 15000, 0.0, 0.5, 0.0), ("a/2.flac", 1, "IOError", 0, 0.0, 0.0, 0.0), ("a/2.flac", 2, None, 18999, 0.01, 0.9999, 0.6), ("a/3.mp3", 1, "ValueError: short clip", None, None, None, None), ("a/4.mp3", 1, "broken", None, None, None, None), ("a/8.mp3", 1, None, 20000, 0.001, 0.5, 0.5)], "audio_path string, at int, err string, cut_hz int, clip double, lr_corr double, silence double")
    songs = spark.createDataFrame(ROWS, SONGS)
    held, earlier = spark.createDataFrame([("a/8.mp3",), ("gone",)], "audio_path string"), spark.createDataFrame([("a/1.mp3",), ("a/1.mp3",)], "audio_path string")
    return {r.id: r for r in X.clean_index(songs, scans, held, earlier).collect()}


def test_flags_duplicates_and_uses(index):
    got = {i: r.flags for i, r in index.items()}
    assert got == {1: ["band_lt16k", "dup"], 2: ["band_lt19k", "clipped", "mono", "silent"], 3: [], 4: ["live", "bad_audio"], 5: ["lyr_few", "acc", "acc_lyrics", "unscanned"], 6: ["junk", "long", "unscanned"], 7: ["short", "unscanned"], 8: []}
    assert index[1].dup_of == 2 and index[2].dup_of is None and index[4].dup_of is None
    assert {i for i, r in index.items() if r.lyric_ok} == {8} and {i for i, r in index.items() if r.audio_ok} == {3, 5, 8}
    assert index[2].cut_hz == 18999 and index[4].cut_hz is None
    assert index[8].split == "dev" and index[1].in_v5 and not index[2].in_v5 and index[1].split == index[2].split == index[4].split


def test_weights_count_what_is_kept(spark):
    songs = spark.createDataFrame([(k, "ne", f"a/{k}.mp3", f"t{k}" if k else "t1", "Ann", "Big" if k < 5 else "", 100.0 + k, None, "none", False, 0) for k in range(12)], SONGS).withColumn("flags", F.when(F.col("id") == 0, F.array(F.lit("dup"))).otherwise(F.array().cast("array<string>"))).withColumn("artist", F.lower("artists"))
    assert {r.id: r.w for r in X.with_weights(songs, 10, 2).collect()} == {k: 0.5 if k < 5 else 0.9091 for k in range(12)}


def test_rows_equal_arrays_in_bounded_batches(spark):
    rows = [(1, "Привет мир Ça"), (2, None), (3, " "), (4, "a b " * 50), (None, "きょう 서울")]
    df = spark.createDataFrame(rows, "k long, t string")
    got = sorted(map(tuple, romanised_rows(df, "k", "t", most=7).collect()), key=str)
    want = df.select("k", F.explode(romanised_words(F.col("t"))).alias("w")).select("k", "w.at", "w.word", "w.roman")
    assert got == sorted(map(tuple, want.collect()), key=str) and len(got) == 105
