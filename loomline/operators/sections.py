"""Lyrics as sections, stanzas and lines, alone or with aligned times; word times folded into lines, sections and songs.

A parse that depends on the order of lines is running counts over (song, line): a marker opens a section, a blank line
behind text lets the next text open a stanza. Rows of one song meet in windows by song; no song is held as a whole but
for the arrays of its units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What ends a line, blanks, a marker line, the markers of text before any marker.
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
BLANK = r"[\x1c-\x1f\p{IsWhite_Space}]"
MARKER = rf"^{BLANK}*\[([^\]]*)\]{BLANK}*\z"
STANZA_MARKER, SECTION_MARKER = "verse", "intro"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def lyric_lines(songs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, kind, text, marker): every line of every song; kind is m (a marker alone in its line), t (text) or b (blank).

    A song without text (null too) has one blank line.
    """
    x = songs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), LINE_END)).alias("line", "raw"))
    body, named = stripped(F.col("raw")), F.col("raw").rlike(MARKER)
    kind = F.when(named, "m").when(body == "", "b").otherwise("t")
    return x.select(key, "line", kind.alias("kind"), body.alias("text"), F.when(named, F.lower(stripped(F.regexp_extract("raw", MARKER, 1)))).alias("marker"))


def _in_song(key: str):
    return Window.partitionBy(key).orderBy("line")


def _before(key: str) -> Column:
    """The kind of the last line above that isn't blank."""
    return F.last(F.when(F.col("kind") != "b", F.col("kind")), ignorenulls=True).over(_in_song(key).rowsBetween(Window.unboundedPreceding, -1))


def with_stanzas(lines: DataFrame, key: str) -> DataFrame:
    """lines with stanza (from 0), opens, and the marker that holds for the line.

    A marker opens a stanza, and so does text that is the first of the song or comes, after blank lines, behind other text.
    """
    opens = (F.col("kind") == "m") | ((F.col("kind") == "t") & (_before(key).isNull() | ((_before(key) == "t") & (F.lag("kind").over(_in_song(key)) == "b"))))
    x = lines.withColumn("opens", opens)
    to_here = _in_song(key).rowsBetween(Window.unboundedPreceding, 0)
    stanza = F.greatest(F.sum(F.col("opens").cast("int")).over(to_here) - 1, F.lit(0)).cast("int")
    return x.withColumn("stanza", stanza).withColumn("marker", F.coalesce(F.last("marker", ignorenulls=True).over(to_here), F.lit(STANZA_MARKER)))


def with_sections(lines: DataFrame, key: str) -> DataFrame:
    """lines with section (from 0) and its marker: sections begin at markers, text before any is an intro. Blank lines above all have none."""
    opens = (F.col("kind") == "m") | ((F.col("kind") == "t") & _before(key).isNull())
    to_here = _in_song(key).rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("section", (F.sum(opens.cast("int")).over(to_here) - 1).cast("int"))
    return x.withColumn("section", F.when(F.col("section") >= 0, F.col("section"))).withColumn("marker", F.when(F.col("section").isNotNull(), F.coalesce(F.last("marker", ignorenulls=True).over(to_here), F.lit(SECTION_MARKER))))


def in_order(order: Column, value: Column, holds: Column) -> Column:
    """An aggregate: the values of the rows for which something holds, by order."""
    return F.transform(F.array_sort(F.collect_list(F.when(holds, F.struct(order.alias("o"), value.alias("v"))))), lambda s: s["v"])


def unit_text(marker: Column, texts: Column, head: Column | bool = True) -> Column:
    """The marker in brackets where the unit is the head of its section, then the lines, each ended."""
    lead = F.when(F.lit(head) if isinstance(head, bool) else head, F.concat(F.lit("["), marker, F.lit("]\n"))).otherwise("")
    return F.concat(lead, F.when(F.size(texts) > 0, F.concat(F.array_join(texts, "\n"), F.lit("\n"))).otherwise(""))


def stanza_units(songs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unit, marker, texts, unit_text): the stanzas of each song; one empty verse where there is nothing."""
    x = with_stanzas(lyric_lines(songs, key, text), key)
    units = x.groupBy(key, F.col("stanza").alias("unit")).agg(F.coalesce(F.max(F.when(F.col("opens"), F.col("marker"))), F.lit(STANZA_MARKER)).alias("marker"), in_order(F.col("line"), F.col("text"), F.col("kind") == "t").alias("texts"))
    return units.withColumn("unit_text", unit_text(F.col("marker"), F.col("texts")))


def line_units(songs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unit, marker, head, texts, unit_text): each text line is a unit, the first below a marker is its head; one empty verse where there is no text."""
    x = lyric_lines(songs, key, text)
    to_here = _in_song(key).rowsBetween(Window.unboundedPreceding, 0)
    part = F.count(F.when(F.col("kind") == "m", 1)).over(to_here)
    x = x.withColumn("part", part).withColumn("marker", F.coalesce(F.last("marker", ignorenulls=True).over(to_here), F.lit(STANZA_MARKER)))
    texts = F.count(F.when(F.col("kind") == "t", 1)).over(Window.partitionBy(key))
    x = x.withColumn("of_song", texts).where((F.col("kind") == "t") | ((F.col("of_song") == 0) & (F.col("line") == 0)))
    head = F.row_number().over(Window.partitionBy(key, "part").orderBy("line")) == 1
    empty = F.col("kind") != "t"
    x = x.withColumn("head", head).withColumn("unit", F.row_number().over(_in_song(key)) - 1)
    x = x.withColumn("texts", F.when(empty, F.array().cast("array<string>")).otherwise(F.array("text"))).withColumn("marker", F.when(empty, STANZA_MARKER).otherwise(F.col("marker")))
    return x.select(key, "unit", "marker", "head", "texts", unit_text(F.col("marker"), F.col("texts"), F.col("head")).alias("unit_text"))


def lyric_sections(songs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Sections (key, section, marker, n_words, n_lines), those without text too, and lines (key, section, line, text, n_words), numbered in their section."""
    x = with_sections(lyric_lines(songs, key, text), key).where("section is not null")
    words = F.size(F.split("text", rf"{BLANK}+"))
    x = x.withColumn("n_words", F.when(F.col("kind") == "t", words).otherwise(0))
    sections = x.groupBy(key, "section").agg(F.first("marker").alias("marker"), F.sum("n_words").cast("int").alias("n_words"), F.count_if(F.col("kind") == "t").cast("int").alias("n_lines"))
    number = (F.row_number().over(Window.partitionBy(key, "section").orderBy("line")) - 1).alias("line")
    return sections, x.where("kind = 't'").select(key, "section", number, "text", "n_words")


def aligned_units(songs: DataFrame, aligned: DataFrame, sections: DataFrame, key: str, text: str) -> DataFrame:
    """(key, unit, marker, texts, start, end, n_align, zipped): the units of each song that has sections, with their times.

    aligned(key, pos, section, text, start, end, n_align) are its aligned lines, pos from 0; sections(key, section, marker,
    start, end, n_align) the aligner's own. Text lines of the song and aligned lines are zipped by position and make
    stanzas (zipped); where their numbers differ the aligner's sections are the units. A unit lasts from the first start
    to the last end of its aligned lines (null if it has none).
    """
    has = sections.select(key).distinct()
    x = with_stanzas(lyric_lines(songs.join(has, key, "left_semi"), key, text), key)
    is_text = F.col("kind") == "t"
    x = x.withColumn("pos", F.when(is_text, F.count(F.when(is_text, 1)).over(_in_song(key)) - 1)).withColumn("n_text", F.count(F.when(is_text, 1)).over(Window.partitionBy(key)))
    counted = aligned.groupBy(key).agg(F.count("*").alias("n_lines"))
    x = x.join(counted, key, "left").where(F.col("n_text") == F.coalesce("n_lines", F.lit(0)))
    timed = aligned.select(key, F.col("pos").cast("long").alias("pos"), F.col("text").alias("sung"), "start", "end", "n_align")
    z = x.join(timed, [key, "pos"], "left")
    has_time = F.col("start").isNotNull()
    units = z.groupBy(key, F.col("stanza").alias("unit")).agg(
        F.coalesce(F.max(F.when(F.col("opens"), F.col("marker"))), F.lit(STANZA_MARKER)).alias("marker"), in_order(F.col("line"), F.col("sung"), is_text).alias("texts"),
        F.min("start").alias("start"), F.max(F.when(has_time, F.col("end"))).alias("end"), F.coalesce(F.sum(F.when(has_time, F.col("n_align"))), F.lit(0)).cast("int").alias("n_align"),
    )
    zipped = x.select(key).distinct()
    own = sections.join(zipped, key, "left_anti").select(key, "section", "marker", "start", "end", F.col("n_align").cast("int").alias("n_align"))
    said = aligned.groupBy(key, "section").agg(in_order(F.col("pos"), F.col("text"), F.lit(True)).alias("texts"))
    number = (F.row_number().over(Window.partitionBy(key).orderBy("section")) - 1).alias("unit")
    back = own.join(said, [key, "section"], "left").select(key, number, "marker", F.coalesce("texts", F.array().cast("array<string>")).alias("texts"), "start", "end", "n_align")
    return units.withColumn("zipped", F.lit(True)).unionByName(back.withColumn("zipped", F.lit(False)))


def folded_lines(lines: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """lines with n_align, start, end, score (and total, the sum of scores) of words(key, section, line, t0, t1, score); without words null, n_align 0.

    Times are rounded to hundredths, scores to thousandths, halves to even.
    """
    own = words.groupBy(key, "section", "line").agg(F.count("*").cast("int").alias("n_align"), F.bround(F.min("t0"), 2).alias("start"), F.bround(F.max("t1"), 2).alias("end"), F.sum("score").alias("total"))
    return lines.join(own, [key, "section", "line"], "left").withColumn("score", F.bround(F.col("total") / F.col("n_align"), 3)).withColumn("n_align", F.coalesce("n_align", F.lit(0)))


def folded_sections(sections: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """sections with n_align, start, end, score and total of their folded lines: times of lines as rounded, scores over words, not lines."""
    own = lines.groupBy(key, "section").agg(F.sum("n_align").cast("int").alias("n_align"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("total").alias("total"))
    joined = sections.join(own, [key, "section"], "left").withColumn("n_align", F.coalesce("n_align", F.lit(0)))
    return joined.withColumn("score", F.bround(F.col("total") / F.when(F.col("n_align") > 0, F.col("n_align")), 3))


def folded_songs(songs: DataFrame, words: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lines, sections, score): each song's word times folded, as nested arrays in order; score is the mean over its aligned words, null without any."""
    sections, lines = lyric_sections(songs, key, text)
    lines = folded_lines(lines, words, key)
    sections = folded_sections(sections, lines, key)
    in_song = lambda x, *cols: x.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("a"), F.sum("total").alias("total"), F.sum("n_align").alias("n"))
    l = in_song(lines, "section", "line", "text", "n_words", "n_align", "start", "end", "score").select(key, F.col("a").alias("lines"))  # noqa: E741
    s = in_song(sections, "section", "marker", "n_words", "n_align", "start", "end", "score").select(key, F.col("a").alias("sections"), (F.col("total") / F.when(F.col("n") > 0, F.col("n"))).alias("score"))
    return songs.select(key).join(l, key, "left").join(s, key, "left").select(key, "lines", "sections", "score")
