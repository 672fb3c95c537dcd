"""Sections, stanzas and lines of lyrics, zips with aligned lines, folds of word times."""

import pytest
from pyspark.sql import functions as F

from loomline.operators import sections as S
from loomline.operators.filters import alignment_reason

LYRICS = "  first line \n\n\nsecond \nthird\r\n[ Chorus ]\r\n\n la la\n\n[Bridge]\n [OUTRO\u3000] \nend\x0b\x0c more\n\nlast\n"


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("id", cols[0]).collect()]


@pytest.fixture
def songs(spark):
    return spark.createDataFrame([(1, LYRICS), (2, None), (3, " \n "), (4, "[Intro]\n[x] y\n"), (5, "[Verse 1]")], "id long, text string")


def test_stanzas(songs):
    got = S.stanza_units(songs.where("id = 1"), "id", "text")
    assert rows(got, "unit", "marker", "texts") == [(0, "verse", ["first line"]), (1, "verse", ["second", "third"]), (2, "chorus", ["la la"]), (3, "bridge", []), (4, "outro", ["end"]), (5, "outro", ["more"]), (6, "outro", ["last"])]
    others = {r.id: r.unit_text for r in S.stanza_units(songs.where("id > 1"), "id", "text").collect()}
    assert others == {2: "[verse]\n", 3: "[verse]\n", 4: "[intro]\n[x] y\n", 5: "[verse 1]\n"}


def test_lines(songs):
    got = S.line_units(songs, "id", "text")
    assert [r[1] for r in rows(got.where("id = 1"), "unit", "unit_text")] == ["[verse]\nfirst line\n", "second\n", "third\n", "[chorus]\nla la\n", "[outro]\nend\n", "more\n", "last\n"]
    assert {r.id: r.unit_text for r in got.where("id > 1").collect()} == {2: "[verse]\n", 3: "[verse]\n", 4: "[intro]\n[x] y\n", 5: "[verse]\n"}


def test_sections_keep_markers_without_text(songs):
    sections, lines = S.lyric_sections(songs, "id", "text")
    assert rows(sections.where("id = 1"), "section", "marker", "n_words", "n_lines") == [(0, "intro", 4, 3), (1, "chorus", 2, 1), (2, "bridge", 0, 0), (3, "outro", 3, 3)]
    assert rows(lines.where("id = 1 and section = 3"), "line", "text") == [(0, "end"), (1, "more"), (2, "last")]
    assert sections.where("id in (2, 3)").count() == 0 and rows(sections.where("id = 5"), "section", "marker") == [(0, "verse 1")]


def test_zip_or_fall_back(spark):
    songs = spark.createDataFrame([(1, "a\nb\n\n[C]\nc"), (2, "a\nb"), (3, "[only]"), (4, "not aligned")], "id long, text string")
    aligned = spark.createDataFrame([(1, 0, 0, "A", 1.0, 2.0, 2), (1, 1, 0, "B", None, None, 3), (1, 2, 1, "C", 5.0, 4.5, 1), (2, 0, 7, "A", 1.0, 2.0, 2)], "id long, pos int, section int, text string, start double, end double, n_align int")
    sections = spark.createDataFrame([(1, 0, "x", 0.0, 9.0, 9), (2, 7, "intro", 1.0, 2.0, 2), (2, 8, "coda", None, None, 0), (3, 0, "only", None, None, 0)], "id long, section int, marker string, start double, end double, n_align int")
    got = S.aligned_units(songs, aligned, sections, "id", "text").orderBy("id", "unit")
    assert [tuple(r) for r in got.collect()] == [(1, 0, "verse", ["A", "B"], 1.0, 2.0, 2, True), (1, 1, "c", ["C"], 5.0, 4.5, 1, True), (2, 0, "intro", ["A"], 1.0, 2.0, 2, False), (2, 1, "coda", [], None, None, 0, False), (3, 0, "only", [], None, None, 0, True)]


def test_folds(spark):
    songs = spark.createDataFrame([(1, "a b\nc\n[X]\n[Y]\nd e f"), (2, "a"), (3, None)], "id long, text string")
    words = spark.createDataFrame([(1, 0, 0, 1.004, 1.5, 0.5), (1, 0, 0, 1.6, 2.006, 1.0), (1, 2, 0, 7.0, 7.5, 0.25), (1, 2, 0, 7.5, 8.0, 0.25), (1, 2, 0, 8.0, 9.0, 0.25)], "id long, section int, line int, t0 double, t1 double, score double")
    got = {r.id: r for r in S.folded_songs(songs, words, "id", "text").collect()}
    assert [tuple(x) for x in got[1].lines] == [(0, 0, "a b", 2, 2, 1.0, 2.01, 0.75), (0, 1, "c", 1, 0, None, None, None), (2, 0, "d e f", 3, 3, 7.0, 9.0, 0.25)]
    assert [tuple(x) for x in got[1].sections] == [(0, "intro", 3, 2, 1.0, 2.01, 0.75), (1, "x", 0, 0, None, None, None), (2, "y", 3, 3, 7.0, 9.0, 0.25)]
    assert got[1].score == 2.25 / 5 and got[2].score is None and got[3].sections is None


def test_why_an_alignment_is_not_used(spark):
    good = [(0.0, 4.0, 9), (None, None, 0)]
    cases = [(None, 9, 9, good, None), (0.03, 9, 9, good, None), (0.9, 7, 9, good, None), (0.9, 9, 9, [(0.0, 0.5, 9)], None), (0.9, 9, 9, [(None, None, 0)], None), (0.9, 9, 9, [(0.0, 0.1, 7)], None), (0.04, 8, 10, good, None), (0.9, 0, 0, good, "bad file")]
    df = spark.createDataFrame(cases, "score double, n_align int, n_words int, sections array<struct<start:double,end:double,n_align:int>>, error string")
    got = df.select(alignment_reason(F.col("score"), F.col("n_align"), F.col("n_words"), "sections", F.col("error")).alias("r")).collect()
    assert [r.r for r in got] == ["no_score", "low_score", "unromanized", "squeezed", "no_aligned_section", None, None, "bad file"]


def test_one_shuffle_for_the_parse(songs):
    plan = S.with_stanzas(S.lyric_lines(songs, "id", "text"), "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
