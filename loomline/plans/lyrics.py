"""Lyric queries: documents, with markers and blank lines put in by a rule, stand for song lyrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as N
from ..functions import text as T
from ..functions.translit import romanised_rows
from ..operators import clean_index as X
from ..operators import sections as S
from .base import query, table

#: Line j of a document is a marker, a blank line or its own text, by doc_id + j.
SONG_LINES = """d AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS own FROM documents),
    x AS (SELECT doc_id, line, (doc_id + line) % 7 = 0 AS m, CASE WHEN (doc_id + line) % 7 = 0 THEN 'part ' || line % 3 END AS mark,
                 CASE WHEN (doc_id + line) % 7 = 0 OR (doc_id + line) % 5 = 0 THEN '' ELSE regexp_replace(own, '^\\s+|\\s+$', '', 'g') END AS text FROM d),
    k AS (SELECT doc_id, line, mark, text, CASE WHEN m THEN 'm' WHEN text = '' THEN 'b' ELSE 't' END AS kind FROM x)"""
STANZAS = f"""{SONG_LINES},
    h AS (SELECT *, last_value(CASE WHEN kind <> 'b' THEN kind END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held, lag(kind) OVER w AS prev,
                 coalesce(last_value(mark IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'verse') AS marker FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
    o AS (SELECT *, kind = 'm' OR (kind = 't' AND (held IS NULL OR (held = 't' AND prev = 'b'))) AS opens FROM h),
    u AS (SELECT *, CAST(greatest(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) - 1, 0) AS INTEGER) AS unit FROM o)"""


def songs(spark, sf_dir):
    """(doc_id, text): lines replaced by markers and blanks, in the writings that a parser must take alike."""
    line = lambda s, j: F.when((F.col("doc_id") + j) % 7 == 0, F.concat(F.lit(" [ Part "), (j % 3).cast("string"), F.lit("] "))).when((F.col("doc_id") + j) % 5 == 0, " \t").otherwise(s)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


@query(f"""WITH {STANZAS}, g AS (SELECT doc_id, unit, coalesce(max(CASE WHEN opens THEN marker END), 'verse') AS marker, coalesce(list(text ORDER BY line) FILTER (kind = 't'), []) AS texts FROM u GROUP BY 1, 2)
    SELECT doc_id, unit, marker, CAST(len(texts) AS INTEGER) AS n_lines, '[' || marker || ']' || chr(10) || CASE WHEN len(texts) > 0 THEN array_to_string(texts, chr(10)) || chr(10) ELSE '' END AS unit_text FROM g""")
def section_units(spark, sf_dir):
    """Stanzas of whole texts, by markers and blank lines."""
    return S.stanza_units(songs(spark, sf_dir), "doc_id", "text").select("doc_id", "unit", "marker", F.size("texts").alias("n_lines"), "unit_text")


@query(f"""WITH {SONG_LINES}, p AS (SELECT *, count(mark) OVER (PARTITION BY doc_id ORDER BY line) AS part, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'verse') AS marker FROM k),
    t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY line) = 1 AS head FROM p WHERE kind = 't')
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INTEGER) AS unit, head, CASE WHEN head THEN '[' || marker || ']' || chr(10) ELSE '' END || text || chr(10) AS unit_text FROM t
    UNION ALL SELECT doc_id, 0, true, '[verse]' || chr(10) FROM k GROUP BY doc_id HAVING count(*) FILTER (kind = 't') = 0""")
def line_units(spark, sf_dir):
    """A unit for each text line, with the marker on the first of its section."""
    return S.line_units(songs(spark, sf_dir), "doc_id", "text").select("doc_id", "unit", "head", "unit_text")


#: The aligner's lines: those of the song, but the last one is lost for each third document; each fourth has no time.
ALIGNED = """t AS (SELECT doc_id, line, text, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM k WHERE kind = 't'),
    a AS (SELECT doc_id, line, pos, pos // 4 AS section, '~' || text AS text, CASE WHEN (doc_id + pos) % 4 <> 0 THEN pos * 2.5 END AS t0, CASE WHEN (doc_id + pos) % 4 <> 0 THEN pos * 2.5 + 2 END AS t1, (doc_id + pos) % 5 AS n_align
          FROM t WHERE doc_id % 3 <> 0 OR pos < n - 1),
    s AS (SELECT doc_id, section, 'part ' || section AS marker, min(t0) AS t0, max(t1) AS t1, sum(n_align) AS n_align, list(text ORDER BY pos) AS texts FROM a GROUP BY 1, 2)"""


@query(f"""WITH {STANZAS}, {ALIGNED}, c AS (SELECT doc_id, count(*) AS n FROM a GROUP BY 1), f AS (SELECT doc_id FROM t JOIN c USING (doc_id) GROUP BY doc_id HAVING max(t.n) = max(c.n)),
    z AS (SELECT u.doc_id, u.unit, u.opens, u.marker, u.line, a.text, a.t0, a.t1, a.n_align FROM u JOIN f USING (doc_id) LEFT JOIN a ON a.doc_id = u.doc_id AND a.line = u.line)
    SELECT doc_id, unit, coalesce(max(CASE WHEN opens THEN marker END), 'verse') AS marker, coalesce(array_to_string(list(text ORDER BY line) FILTER (text IS NOT NULL), '/'), '') AS texts, CAST(min(t0) AS DOUBLE) AS start, CAST(max(t1) AS DOUBLE) AS "end",
           CAST(coalesce(sum(n_align) FILTER (t0 IS NOT NULL), 0) AS INTEGER) AS n_align, true AS zipped FROM z GROUP BY 1, 2
    UNION ALL SELECT doc_id, CAST(section AS INTEGER), marker, array_to_string(texts, '/'), CAST(t0 AS DOUBLE), CAST(t1 AS DOUBLE), CAST(n_align AS INTEGER), false FROM s WHERE doc_id NOT IN (SELECT doc_id FROM f)""")
def aligned_section_units(spark, sf_dir):
    """Stanzas with the times of their aligned lines, or the aligner's sections where the numbers of lines differ."""
    from pyspark.sql.window import Window

    own = songs(spark, sf_dir)
    w = Window.partitionBy("doc_id")
    t = S.lyric_lines(own, "doc_id", "text").where("kind = 't'").withColumn("pos", F.row_number().over(w.orderBy("line")) - 1).withColumn("n", F.count("*").over(w))
    timed = lambda x: F.when((F.col("doc_id") + F.col("pos")) % 4 != 0, x)
    a = t.where("doc_id % 3 <> 0 or pos < n - 1").select("doc_id", "pos", F.floor(F.col("pos") / 4).alias("section"), F.concat(F.lit("~"), "text").alias("text"), timed(F.col("pos") * 2.5).alias("start"), timed(F.col("pos") * 2.5 + 2).alias("end"), ((F.col("doc_id") + F.col("pos")) % 5).alias("n_align"))
    s = a.groupBy("doc_id", "section").agg(F.concat(F.lit("part "), F.first("section").cast("string")).alias("marker"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_align").alias("n_align"))
    return S.aligned_units(own, a, s, "doc_id", "text").select("doc_id", "unit", "marker", F.array_join("texts", "/").alias("texts"), "start", "end", "n_align", "zipped")


#: Sections as the aligner has them; words of a line by position i, those with a time by a rule.
FOLDED = f"""WITH {SONG_LINES},
    h AS (SELECT *, last_value(CASE WHEN kind <> 'b' THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM k),
    c AS (SELECT *, sum(CASE WHEN kind = 'm' OR (kind = 't' AND held IS NULL) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS section FROM h),
    l AS (SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id, section ORDER BY line) - 1 AS li, string_split_regex(text, '\\s+') AS words FROM c WHERE kind = 't'),
    q AS (SELECT doc_id, section, li, unnest(range(0, len(words))) AS i, len(words) AS n FROM l),
    w AS (SELECT doc_id, section, li, li * 40 + i * 0.31 AS t0, li * 40 + i * 0.31 + 0.27 AS t1, ((doc_id + i) % 61) / 61.0 AS score FROM q WHERE (doc_id + li) % 4 <> 0 AND (doc_id + li + i) % 3 <> 0),
    f AS (SELECT l.doc_id, l.section, l.li, len(words) AS n_words, v.n_align, v.a, v.b, v.total FROM l
          LEFT JOIN (SELECT doc_id, section, li, count(*) AS n_align, round_even(min(t0), 2) AS a, round_even(max(t1), 2) AS b, sum(score) AS total FROM w GROUP BY 1, 2, 3) v USING (doc_id, section, li)),
    g AS (SELECT doc_id, section, coalesce(max(mark), 'intro') AS marker FROM c WHERE section >= 0 GROUP BY 1, 2)"""


@query(f"""{FOLDED} SELECT g.doc_id, CAST(g.section AS INTEGER) AS section, g.marker, CAST(coalesce(sum(n_words), 0) AS INTEGER) AS n_words, CAST(coalesce(sum(n_align), 0) AS INTEGER) AS n_align,
    CAST(count(f.li) AS INTEGER) AS n_lines, CAST(round(min(a), 2) AS DOUBLE) AS start, CAST(round(max(b), 2) AS DOUBLE) AS "end", round(sum(total) / sum(n_align), 3) AS score FROM g LEFT JOIN f USING (doc_id, section) GROUP BY 1, 2, 3""")
def folded_sections(spark, sf_dir):
    """Word times folded into lines, these into sections and songs; a row for each section of the nested result."""
    own = songs(spark, sf_dir)
    _, lines = S.lyric_sections(own, "doc_id", "text")
    w = lines.select("doc_id", "section", "line", F.posexplode(F.split("text", r"\s+")).alias("i", "w")).where("(doc_id + line) % 4 <> 0 and (doc_id + line + i) % 3 <> 0")
    w = w.select("doc_id", "section", "line", (F.col("line") * 40 + F.col("i") * 0.31).alias("t0"), (F.col("line") * 40 + F.col("i") * 0.31 + 0.27).alias("t1"), (((F.col("doc_id") + F.col("i")) % 61) / 61).alias("score"))
    out = S.folded_songs(own, w, "doc_id", "text")
    n_lines = F.size(F.filter("lines", lambda l: l["section"] == F.col("s.section")))
    return out.select("doc_id", "lines", F.explode("sections").alias("s")).select("doc_id", "s.section", "s.marker", "s.n_words", "s.n_align", F.coalesce(F.when(F.col("lines").isNotNull(), n_lines), F.lit(0)).alias("n_lines"), F.round("s.start", 2).alias("start"), F.round("s.end", 2).alias("end"), F.round("s.score", 3).alias("score"))


def in_sql(pattern: str) -> str:
    """A pattern of the library for DuckDB: its classes of letters and blanks spelt out, as there they know ASCII only."""
    named = {"w": r"\p{L}\p{N}_", "s": r"\s\p{Z}\x0b", "W": None}
    out, inside, k = [], False, 0
    body = pattern.replace("(?iU)", "(?i)").replace("(?U)", "")
    while k < len(body):
        c = body[k]
        if c == "\\" and body[k + 1] in named:
            out.append(r"[^\p{L}\p{N}_]" if body[k + 1] == "W" else named[body[k + 1]] if inside else f"[{named[body[k + 1]]}]")
            k += 2
            continue
        if c == "\\":
            out.append(body[k : k + 2])
            k += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(c)
        k += 1
    return "".join(out).replace("'", "''")


BLANKS = r"[\s\p{Z}\x0b]"
CLEANED = f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS t FROM documents),
    h AS (SELECT *, i < 2 AND (contains(t, ' - ') OR contains(t, '《')) AS title FROM l),
    a AS (SELECT doc_id, i, t, regexp_matches(t, '{in_sql(N.NOTICE)}') AS notice, regexp_matches(t, '{in_sql(N.SECTION)}') OR regexp_matches(t, '{in_sql(N.SECTION_HEAD)}') AS section, regexp_replace(t, '{in_sql(N.SINGER)}', '') AS t1 FROM h WHERE NOT title),
    b AS (SELECT *, regexp_replace(regexp_replace(t1, '{in_sql(N.TAG)}', ' ', 'g'), '^{BLANKS}+|{BLANKS}+$', '', 'g') AS t2 FROM a),
    c AS (SELECT *, regexp_matches(t2, '{in_sql(N.COLON)}') AS m, regexp_extract(t2, '{in_sql(N.COLON)}', 1) AS label, regexp_replace(regexp_extract(t2, '{in_sql(N.COLON)}', 2), '{BLANKS}+$', '') AS rest FROM b),
    d AS (SELECT *, m AND (regexp_matches(label, '{N.CREDIT_WORD}') OR list_contains(['{"', '".join(N.SHORT_CREDITS)}'], trim(label)) OR rest = '') AS c1,
          m AND length(label) <= 6 AND regexp_matches(label, '^[\\p{{L}}\\p{{N}}_·]+$') AND NOT regexp_matches(label, '[a-zA-Z]') AS r FROM c),
    e AS (SELECT *, CASE WHEN r THEN rest ELSE t2 END AS t3 FROM d),
    f AS (SELECT *, NOT notice AND NOT section AND t2 <> '' AND c1 AS c2, NOT notice AND NOT section AND NOT (t2 <> '' AND c1) AND regexp_matches(CASE WHEN t2 = '' THEN t2 ELSE t3 END, '{in_sql(N.LEAD_CREDIT)}') AS c3 FROM e),
    g AS (SELECT *, notice OR section OR c2 OR c3 AS gone, CASE WHEN notice OR section OR c2 OR c3 THEN '' ELSE regexp_replace(regexp_replace(t3, '{BLANKS}+', ' ', 'g'), '^{BLANKS}+|{BLANKS}+$', '', 'g') END AS t4 FROM f)"""


@query(f"""{CLEANED} SELECT l.doc_id, coalesce(max(x.lines), 0) AS n_lines, coalesce(max(x.text), '') AS text, coalesce(max(y.titles), 0) AS title, coalesce(max(x.notice), 0) AS notice, coalesce(max(x.section), 0) AS section,
      coalesce(max(x.singer), 0) AS singer, coalesce(max(x.credit), 0) AS credit, coalesce(max(x.role), 0) AS role, coalesce(max(x.dropped), 0) AS dropped_lines, coalesce(max(x.changed), 0) AS lines_changed
    FROM l LEFT JOIN (SELECT doc_id, CAST(count(*) FILTER (t4 <> '') AS INTEGER) AS lines, coalesce(array_to_string(list(t4 ORDER BY i) FILTER (t4 <> ''), chr(10)), '') AS text, CAST(count(*) FILTER (notice) AS INTEGER) AS notice,
      CAST(count(*) FILTER (section AND NOT notice) AS INTEGER) AS section, CAST(count(*) FILTER (NOT notice AND NOT section AND t <> '' AND t1 <> t) AS INTEGER) AS singer, CAST(count(*) FILTER (c2 OR c3) AS INTEGER) AS credit,
      CAST(count(*) FILTER (NOT notice AND NOT section AND t2 <> '' AND NOT c1 AND r) AS INTEGER) AS role, CAST(count(*) FILTER (t4 = '') AS INTEGER) AS dropped, CAST(count(*) FILTER (NOT gone AND t3 <> t) AS INTEGER) AS changed FROM g GROUP BY 1) x USING (doc_id)
    LEFT JOIN (SELECT doc_id, CAST(count(*) FILTER (title) AS INTEGER) AS titles FROM h GROUP BY 1) y USING (doc_id) GROUP BY 1""")
def cleaned_lines(spark, sf_dir):
    """All lines of all documents through the line rules, with a counter for each rule.

    Documents are dealt out first: the rules take about half a millisecond a line, far more than moving it.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    x = N.clean_report(d, "lines", F.lit(""))
    return x.select("doc_id", F.size("lines").alias("n_lines"), F.array_join("lines", "\n").alias("text"), *[F.col("counts")[c].alias(c) for c in ("title", "notice", "section", "singer", "credit", "role", "dropped_lines", "lines_changed")])


@query(f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS t FROM documents),
    m AS (SELECT *, regexp_matches(t, '{in_sql(N.SPEAKER)}') AS m, regexp_extract(t, '{in_sql(N.SPEAKER)}', 1) AS label, regexp_replace(regexp_extract(t, '{in_sql(N.SPEAKER)}', 2), '{BLANKS}+$', '') AS rest FROM l)
    SELECT doc_id, CAST(i AS INTEGER) AS line, CASE WHEN regexp_matches(t, '{in_sql(N.NOTICE_LINE)}') THEN NULL WHEN NOT m THEN t WHEN rest = '' OR regexp_matches(label, '{in_sql(N.ROLE)}') THEN NULL
      WHEN length(label) <= 6 OR contains(label, '+') OR contains(label, '合') THEN rest ELSE t END AS sung FROM m""")
def sung_lines(spark, sf_dir):
    """What is sung of each line, by the rules for credits among timed lines."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return d.select("doc_id", "line", N.sung_text(F.col("t")).alias("sung"))


@query("""WITH w AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda v: v <> '') AS w FROM documents))
    SELECT doc_id, CAST(i AS INTEGER) AS i, regexp_replace(strip_accents(replace(lower(word), 'ß', 'ss')), '[^a-z'']', '', 'g') AS roman FROM w""")
def romanised_words(spark, sf_dir):
    """Every word of every document in the letters a-z, at its place among all words; documents are dealt out before the Python part."""
    own = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return romanised_rows(own, "doc_id", "text").select("doc_id", F.col("at").alias("i"), "roman")


@query("""WITH s AS (SELECT doc_id AS id, ['ne', 'kg', 'jm', 'yt'][1 + doc_id % 4] AS source, 'a/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.flac' ELSE '.mp3' END AS audio_path,
      'Song ' || (doc_id % 7) || CASE WHEN doc_id % 23 = 0 THEN ' audiobook' WHEN doc_id % 29 = 0 THEN ' Karaoke' ELSE '' END AS title, lang AS artist, lower(source) AS album, n_chars / 8.0 AS duration,
      CASE doc_id % 5 WHEN 0 THEN 48000 WHEN 1 THEN 0 ELSE 44100 END AS sr, CASE doc_id % 6 WHEN 0 THEN 'untimed' WHEN 1 THEN 'none' WHEN 2 THEN 'instrumental' ELSE 'timed' END AS kind, doc_id % 11 = 0 AS live, len(string_split(text, chr(10))) AS n_lines FROM documents),
    t AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS nt, contains(title, 'audiobook') AS junk, contains(title, 'Karaoke') AS acc, kind = 'timed' AS timed FROM s),
    e AS (SELECT event_id AS id, CASE WHEN event_id % 17 = 0 THEN 'IOError' WHEN event_id % 19 = 0 THEN 'ValueError: short' END AS err, 12000 + event_id % 9000 AS cut, (event_id % 13) / 5000.0 AS clip, event_id % 8 = 0 AS mono, value / 20 AS silence FROM events WHERE event_id % 9 <> 0),
    f AS (SELECT t.*, CASE WHEN e.err IS NULL THEN cut END AS cut_hz, list_filter([CASE WHEN timed AND n_lines < 4 THEN 'lyr_few' END, CASE WHEN junk THEN 'junk' END, CASE WHEN duration < 60 THEN 'short' END, CASE WHEN duration > 600 THEN 'long' END, CASE WHEN acc THEN 'acc' END,
      CASE WHEN acc AND timed THEN 'acc_lyrics' END, CASE WHEN live THEN 'live' END, CASE WHEN e.id IS NULL THEN 'unscanned' END, CASE WHEN err = 'IOError' THEN 'bad_audio' END, CASE WHEN err IS NULL AND cut < 16000 THEN 'band_lt16k' WHEN err IS NULL AND cut < 19000 THEN 'band_lt19k' END,
      CASE WHEN err IS NULL AND clip > 0.001 THEN 'clipped' END, CASE WHEN err IS NULL AND mono THEN 'mono' END, CASE WHEN err IS NULL AND silence > 0.5 THEN 'silent' END], lambda v: v IS NOT NULL) AS flags FROM t LEFT JOIN e USING (id)),
    g AS (SELECT *, sum(CASE WHEN gap <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY nt, artist, live ORDER BY duration, id) AS k FROM (SELECT *, duration - lag(duration) OVER (PARTITION BY nt, artist, live ORDER BY duration, id) AS gap FROM f)),
    b AS (SELECT *, first_value(id) OVER (PARTITION BY nt, artist, live, k ORDER BY CASE kind WHEN 'timed' THEN 3 WHEN 'untimed' THEN 2 WHEN 'instrumental' THEN 1 ELSE 0 END DESC, junk, audio_path LIKE '%.flac' DESC, sr >= 48000 DESC,
      CASE source WHEN 'ne' THEN 5 WHEN 'kg' THEN 4 WHEN 'jm' THEN 3 ELSE 1 END DESC, n_lines DESC, duration, id) AS best FROM g),
    d AS (SELECT *, CASE WHEN best <> id THEN best END AS dup_of, CASE WHEN best <> id THEN flags || ['dup'] ELSE flags END AS fl, nt IN (SELECT nt FROM t WHERE id % 41 = 0) AS forced, CAST('0x' || substr(md5(nt), 1, 8) AS BIGINT) % 1000 AS h FROM b),
    n AS (SELECT *, count(*) FILTER (dup_of IS NULL) OVER (PARTITION BY artist) AS na, count(*) FILTER (dup_of IS NULL) OVER (PARTITION BY album) AS nb FROM d)
    SELECT id, cut_hz, array_to_string(fl, ',') AS flags, dup_of, CASE WHEN forced OR h BETWEEN 5 AND 9 THEN 'dev' WHEN h < 5 THEN 'test' ELSE 'train' END AS split, id % 3 = 0 AS in_v5, round(least(1.0, coalesce(30.0 / nullif(na, 0), 1.0), coalesce(20.0 / nullif(nb, 0), 1.0)), 4) AS w,
      timed AND NOT list_has_any(fl, ['bad_audio', 'silent', 'lyr_few', 'acc_lyrics', 'acc', 'junk', 'dup', 'short', 'long']) AS lyric_ok, NOT list_has_any(fl, ['junk', 'dup', 'bad_audio', 'silent']) AND duration BETWEEN 30 AND 900 AS audio_ok FROM n""")
def clean_index(spark, sf_dir):
    """Documents as songs, events as scans of their files: the whole clean index."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    path = lambda i: F.concat(F.lit("a/"), i.cast("string"), F.when(i % 3 == 0, ".flac").otherwise(".mp3"))
    title = F.concat(F.lit("Song "), (i % 7).cast("string"), F.when(i % 23 == 0, " audiobook").when(i % 29 == 0, " Karaoke").otherwise(""))
    sources = F.get(F.array(*map(F.lit, ("ne", "kg", "jm", "yt"))), (i % 4).cast("int"))
    kinds = F.get(F.array(*map(F.lit, ("untimed", "none", "instrumental", "timed", "timed", "timed"))), (i % 6).cast("int"))
    sr = F.when(i % 5 == 0, 48000).when(i % 5 != 1, 44100)
    own = d.select(i.alias("id"), sources.alias("source"), path(i).alias("audio_path"), title.alias("title"), F.concat("lang", F.lit(", x")).alias("artists"), F.upper("source").alias("album"), (F.col("n_chars") / 8).alias("duration"), sr.alias("sr"), kinds.alias("lyric_kind"), (i % 11 == 0).alias("is_live"), F.size(F.split("text", "\n")).alias("n_lines"))
    e = F.col("event_id")
    err = F.when(e % 17 == 0, "IOError").when(e % 19 == 0, "ValueError: short")
    scans = table(spark, sf_dir, "events").where("event_id % 9 <> 0").select(path(e).alias("audio_path"), e.alias("at"), err.alias("err"), (12000 + e % 9000).alias("cut_hz"), ((e % 13) / 5000).alias("clip"), F.when(e % 8 == 0, 1.0).otherwise(0.5).alias("lr_corr"), (F.col("value") / 20).alias("silence"))
    x = X.with_splits(X.with_duplicates(X.with_scan(X.titled(own).withColumn("flags", X.text_flags()), scans)), d.where("doc_id % 41 = 0").select(path(i).alias("audio_path")), d.where("doc_id % 3 = 0").select(path(i).alias("audio_path")))
    return X.with_uses(X.with_weights(x, 30, 20)).select("id", "cut_hz", F.array_join("flags", ",").alias("flags"), "dup_of", "split", "in_v5", "w", "lyric_ok", "audio_ok")


@query("""WITH l AS (SELECT doc_id, lang, source, n_chars, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS t FROM documents),
    r AS (SELECT doc_id, i, printf('[%02d:%02d.0] ', (i * 7) // 60, (i * 7) % 60) || trim(regexp_replace(t, '\\s+', ' ', 'g')) AS line FROM l),
    h AS (SELECT doc_id, 'User: ' || CASE lang WHEN 'de' THEN 'Mach ein Lied.' WHEN 'fr' THEN 'Fais une chanson.' WHEN 'es' THEN 'Haz una canción.' ELSE 'Make a song.' END || chr(10) || 'title: ' || source || chr(10) || 'lang: ' || lang || chr(10) || 'is_live: ' || (doc_id % 2 = 0)
      || chr(10) || 'dur: ' || printf('%.1f', n_chars / 4.0) || chr(10) || 'lines:' || chr(10) AS head FROM documents),
    n AS (SELECT doc_id, i, line, length(head) + coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(line) > 900 AS over FROM r JOIN h USING (doc_id)),
    k AS (SELECT doc_id, i, line, bool_or(over) OVER (PARTITION BY doc_id ORDER BY i) AS gone FROM n),
    j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS lines FROM k GROUP BY 1)
    SELECT doc_id, rtrim(head || coalesce(lines, ''), chr(10)) || chr(10) || chr(10) || 'Assistant: <think></think>' AS prompt FROM h JOIN j USING (doc_id)""")
def song_prompts(spark, sf_dir):
    """A prompt of 900 characters at most for each document as a song: request, fields, then the lines that fit."""
    d = table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.struct((i * 7).cast("double").alias("t0"), t.alias("text")))
    request = T.request_text(F.element_at(F.create_map(*map(F.lit, ("de", "deu", "fr", "fra", "es", "spa", "en", "eng"))), F.col("lang")))
    return d.select("doc_id", T.song_prompt(request, {"title": F.col("source"), "lang": F.col("lang")}, F.col("doc_id") % 2 == 0, F.col("n_chars") / 4, lines, most=900).alias("prompt"))
