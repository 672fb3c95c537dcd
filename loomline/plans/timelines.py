"""Timeline queries: events of a user stand for the timed lines of a song."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import crops as C
from ..operators import joins as J
from ..operators import windows as W
from .base import query, table

#: Seconds since 2024-01-01 of an event, in both languages.
SECONDS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) / 1000000.0D"
SQL_T0 = "date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1000000.0"
LINES = f"l AS (SELECT event_id, user_id, event_type, value, {SQL_T0} AS t0 FROM events)"
NEXT = f"{LINES}, n AS (SELECT *, coalesce(lead(t0) OVER (PARTITION BY user_id ORDER BY t0, event_id), t0 + 60) AS t1 FROM l)"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type", "value", f"cast({SECONDS} as double) t0")


def spans(spark, sf_dir):
    return W.line_ends(lines(spark, sf_dir), "user_id", ["t0", "event_id"], "t0", F.col("t0") + 60, "t1")


@query(f"WITH {NEXT} SELECT event_id, round(t1, 3) AS t1 FROM n")
def line_lead_t1(spark, sf_dir):
    return spans(spark, sf_dir).select("event_id", F.round("t1", 3).alias("t1"))


@query(f"WITH {NEXT} SELECT event_id, round(least(least(greatest(t1, t0), t0 + 3600), t0 + 3.0 + 0.6 * length(event_type)), 3) AS t1 FROM n")
def capped_line_end(spark, sf_dir):
    return spans(spark, sf_dir).select("event_id", F.round(W.capped_end(F.col("t0"), F.col("t1"), F.col("t0") + 3600, F.length("event_type")), 3).alias("t1"))


@query(f"""WITH {LINES}, e AS (SELECT *, t0 + value AS t1 FROM l)
    SELECT event_id, coalesce(t0 - lag(t1) OVER w >= 20000 OR t0 - lag(t0) OVER w >= 40000, false) AS gap FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t0, event_id)""")
def stanza_gap(spark, sf_dir):
    return W.stanza_gap(lines(spark, sf_dir).withColumn("t1", F.col("t0") + F.col("value")), "user_id", ["t0", "event_id"], "t0", "t1", 20000, 40000).select("event_id", "gap")


@query(f"""WITH RECURSIVE {LINES}, o AS (SELECT user_id, t0, t0 + 100 AS t1, row_number() OVER (PARTITION BY user_id ORDER BY t0, t0 + 100) AS r FROM l),
    s AS (SELECT user_id, r, t0, t1, 0 AS k, t0 AS a, t1 AS b, 1 AS n FROM o WHERE r = 1 UNION ALL
      SELECT o.user_id, o.r, o.t0, o.t1, CASE WHEN o.t0 - s.b < 30000 AND o.t0 - s.a < 100000 AND s.n < 6 THEN s.k ELSE s.k + 1 END,
        CASE WHEN o.t0 - s.b < 30000 AND o.t0 - s.a < 100000 AND s.n < 6 THEN s.a ELSE o.t0 END, o.t1,
        CASE WHEN o.t0 - s.b < 30000 AND o.t0 - s.a < 100000 AND s.n < 6 THEN s.n + 1 ELSE 1 END FROM s JOIN o ON o.user_id = s.user_id AND o.r = s.r + 1)
    SELECT user_id, CAST(k AS INTEGER) AS k, round(min(t0), 3) AS start, round(max(t1), 3) AS "end", CAST(count(*) AS INTEGER) AS n FROM s GROUP BY user_id, k""")
def bounded_session(spark, sf_dir):
    out = W.bounded_sessions(lines(spark, sf_dir).withColumn("t1", F.col("t0") + 100), "user_id", "t0", "t1", 30000, 100000, 6)
    return out.select("user_id", "k", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n")


@query("SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY user_id, event_type) >= 2 AND length(event_type) >= 6 THEN 'chorus' ELSE 'verse' END AS marker FROM events")
def repeated_marker(spark, sf_dir):
    return W.repeated_marker(table(spark, sf_dir, "events"), "user_id", T.norm_stanza(F.col("event_type"))).select("event_id", "marker")


B_SECTIONS = """s AS (SELECT l_orderkey AS g, l_linenumber AS k, CASE WHEN l_linestatus = 'O' THEN l_linenumber * 10.0 + l_quantity / 100 END AS a,
    CASE WHEN l_linestatus = 'O' THEN l_linenumber * 10.0 + 8 END AS b, 100.0 AS d FROM lineitem)"""


def sections(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").withColumn("on", F.col("l_linestatus") == "O")
    return s.select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("k"), F.when(F.col("on"), F.col("l_linenumber") * 10.0 + F.col("l_quantity") / 100).alias("a"), F.when(F.col("on"), F.col("l_linenumber") * 10.0 + 8).alias("e"), F.lit(100.0).alias("d")).groupBy("g", "k").agg(F.min("a").alias("a"), F.min("e").alias("e"), F.min("d").alias("d"))


@query(f"""WITH {B_SECTIONS}, u AS (SELECT g, k, min(a) AS a, min(b) AS b, min(d) AS d FROM s GROUP BY g, k),
    o AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY g) AS n, lag(b) OVER w AS pb FROM u WINDOW w AS (PARTITION BY g ORDER BY k)),
    x AS (SELECT *, CASE WHEN i = 0 THEN 0.0 WHEN pb IS NOT NULL AND a IS NOT NULL THEN (pb + a) / 2 WHEN a IS NOT NULL THEN a - 0.5 WHEN pb IS NOT NULL THEN pb + 0.5 END AS v FROM o),
    y AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi, last_value(v IGNORE NULLS) OVER p AS pv, coalesce(first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER f, n) AS qi, coalesce(first_value(v IGNORE NULLS) OVER f, d) AS qv
      FROM x WINDOW p AS (PARTITION BY g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY g ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    z AS (SELECT *, coalesce(v, pv + (qv - pv) * (i - pi) / (qi - pi)) AS w FROM y)
    SELECT g, k, round(least(greatest(max(w) OVER (PARTITION BY g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0), d), 4) AS b FROM z""")
def boundary_interpolate(spark, sf_dir):
    """Middle, half-second and interpolated boundaries, never falling. Lines that share a number are one."""
    return W.boundaries(sections(spark, sf_dir), "g", "k", "a", "e", "d").select("g", "k", F.round("b", 4).alias("b"))


@query(f"WITH {LINES}, x AS (SELECT *, CASE WHEN event_type = 'click' THEN value END AS v FROM l) SELECT event_id, round(coalesce(first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t0, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 4) AS filled FROM x")
def backfill_next(spark, sf_dir):
    x = lines(spark, sf_dir).withColumn("v", F.when(F.col("event_type") == "click", F.col("value")))
    return W.backfill(x, "user_id", ["t0", "event_id"], "v", "f").select("event_id", F.round("f", 4).alias("filled"))


@query(f"WITH {LINES} SELECT min(event_id) AS event_id FROM (SELECT *, round_even(t0 / 3600, 0) AS h FROM l) GROUP BY user_id, h")
def first_per_time(spark, sf_dir):
    """The first line of each rounded time."""
    return W.first_per(lines(spark, sf_dir).withColumn("h", F.bround(F.col("t0") / 3600)), [F.col("user_id"), F.col("h")], ["event_id"]).select("event_id")


@query(f"""WITH {LINES}, x AS (SELECT *, bool_and(value < 60) OVER (PARTITION BY user_id ORDER BY t0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h,
    bool_and(value < 60) OVER (PARTITION BY user_id ORDER BY t0, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t FROM l) SELECT event_id FROM x WHERE NOT (h OR t)""")
def stripped_ends(spark, sf_dir):
    return W.stripped_ends(lines(spark, sf_dir), "user_id", ["t0", "event_id"], F.col("value") < 60).select("event_id")


@query(f"WITH {LINES} SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY t0, event_id) - 1) % 4 AS INTEGER) AS part FROM l")
def modulo_parts(spark, sf_dir):
    return W.part_of(lines(spark, sf_dir), "user_id", ["t0", "event_id"], 4).select("event_id", F.col("part").cast("int").alias("part"))


@query(f"""WITH {LINES}, x AS (SELECT *, list(event_type) OVER (PARTITION BY user_id ORDER BY t0, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS p FROM l)
    SELECT event_id, CAST(coalesce(len(list_filter(p, lambda y: y = event_type)), 0) AS INTEGER) AS seen FROM x""")
def trailing_frequency(spark, sf_dir):
    x = lines(spark, sf_dir).withColumn("o", F.struct("t0", "event_id"))
    return W.trailing_count(x, "user_id", "o", "event_type", 20).select("event_id", "seen")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS t FROM events GROUP BY 1, 2),
    x AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY n DESC, event_type) - n AS before FROM c)
    SELECT user_id, event_type, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS p FROM x WHERE before * 10 < 7 * t""")
def nucleus_filter(spark, sf_dir):
    """The likeliest types of each user while what came before is under seven tenths, in whole numbers."""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    total = c.groupBy("user_id").agg(F.sum("n").alias("t"))
    scaled = c.join(total, "user_id").withColumn("p", F.col("n") * 10).withColumn("cap", 7 * F.col("t"))
    out = W.nucleus(scaled, "user_id", "event_type", "p", F.col("cap"))
    return out.select("user_id", "event_type", F.round("p_kept", 6).alias("p"))


@query(f"""WITH {LINES}, a AS (SELECT event_id AS a_id, user_id, t0 AS a0, t0 + value AS a1 FROM l WHERE event_type = 'view'), b AS (SELECT event_id AS b_id, user_id, t0 AS b0, t0 + 300 AS b1 FROM l WHERE event_type = 'click')
    SELECT a_id, b_id FROM a JOIN b USING (user_id) WHERE a0 + 0.05 < b1 AND a1 - 0.05 > b0""")
def interval_overlap(spark, sf_dir):
    l = lines(spark, sf_dir)  # noqa: E741
    a = l.where("event_type = 'view'").select(F.col("event_id").alias("a_id"), "user_id", F.col("t0").alias("a0"), (F.col("t0") + F.col("value")).alias("a1"))
    b = l.where("event_type = 'click'").select(F.col("event_id").alias("b_id"), "user_id", F.col("t0").alias("b0"), (F.col("t0") + 300).alias("b1"))
    return J.interval_overlap(a, b, "user_id", 600.0, 0.05).select("a_id", "b_id")


@query(f"""WITH {LINES}, p AS (SELECT event_id, user_id, t0 FROM l WHERE event_type <> 'click'), b AS (SELECT event_id AS b_id, user_id, t0 AS b0, t0 + 5000 AS b1 FROM l WHERE event_type = 'click')
    SELECT event_id, count(*) AS n, min(b_id) AS first_id FROM p JOIN b USING (user_id) WHERE b0 <= t0 AND t0 < b1 GROUP BY 1""")
def point_in_interval(spark, sf_dir):
    l = lines(spark, sf_dir)  # noqa: E741
    b = l.where("event_type = 'click'").select(F.col("event_id").alias("b_id"), "user_id", F.col("t0").alias("b0"), (F.col("t0") + 5000).alias("b1"))
    return J.point_in_interval(l.where("event_type <> 'click'").select("event_id", "user_id", "t0"), b, "user_id", "t0", 5000.0).groupBy("event_id").agg(F.count("*").alias("n"), F.min("b_id").alias("first_id"))


@query(f"""WITH {LINES}, p AS (SELECT event_id, user_id, t0 FROM l WHERE event_type = 'purchase'), b AS (SELECT event_id AS item, user_id, t0 AS o FROM l WHERE event_type = 'click'),
    h AS (SELECT event_id, min_by(item, (abs(t0 - o), o, item)) AS item, min(abs(t0 - o)) AS gap FROM p JOIN b USING (user_id) WHERE abs(t0 - o) < 9000 GROUP BY 1)
    SELECT p.event_id, h.item, round(h.gap, 3) AS gap FROM p LEFT JOIN h USING (event_id)""")
def nearest_asof(spark, sf_dir):
    l = lines(spark, sf_dir)  # noqa: E741
    left = l.where("event_type = 'purchase'").select("event_id", "user_id", "t0")
    right = l.where("event_type = 'click'").select("user_id", F.col("t0").alias("o"), F.col("event_id").alias("item"))
    return J.nearest_within(left, right, "user_id", "t0", "o", 9000.0, "item", ["event_id"]).select("event_id", "item", F.round("gap", 3).alias("gap"))


@query(f"""WITH {LINES} SELECT event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY t0, event_id), first_value(event_id) OVER (PARTITION BY user_id ORDER BY t0, event_id)) AS partner FROM l""")
def ring_pairing(spark, sf_dir):
    return J.ring(lines(spark, sf_dir), "user_id", ["t0", "event_id"], "event_id", "partner").select("event_id", "partner")


@query(f"""WITH {LINES}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t0, event_id) AS r FROM l)
    SELECT event_id, min(CASE WHEN event_type = 'purchase' THEN r END) OVER (PARTITION BY user_id ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_at FROM x""")
def forward_asof(spark, sf_dir):
    """The position of the next purchase after each event."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("t0", "event_id")
    x = lines(spark, sf_dir).withColumn("r", F.row_number().over(w))
    return x.select("event_id", F.min(F.when(F.col("event_type") == "purchase", F.col("r"))).over(w.rowsBetween(1, Window.unboundedFollowing)).cast("long").alias("next_at"))


@query("SELECT conv_id, turn, role, CAST(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM conversations")
def running_budget(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.sum(F.length("text") + 1).over(w).cast("long").alias("used"))


#: Events in minutes as lines of a song; every 25th starts a crop of 4000 minutes. Lines have 1 to 4 letters, some without a start.
CROPS = f"""{LINES}, f AS (SELECT user_id, event_id AS line, CAST(floor(t0 / 60) AS BIGINT) AS f0, CAST(floor(t0 / 60) AS BIGINT) + CAST(floor(value * 20) AS BIGINT) AS f1 FROM l),
    c AS (SELECT user_id, line AS crop, f0 - 5 AS c0, 4000 AS n FROM f WHERE line % 25 = 0)"""


def minute_lines(spark, sf_dir):
    return lines(spark, sf_dir).select("user_id", F.col("event_id").alias("line"), F.floor(F.col("t0") / 60).alias("f0"), (F.floor(F.col("t0") / 60) + F.floor(F.col("value") * 20)).alias("f1"))


def minute_crops(f):
    return f.where("line % 25 = 0").select("user_id", F.col("line").alias("crop"), (F.col("f0") - 5).alias("c0"), F.lit(4000).cast("long").alias("n"))


@query(f"""WITH {CROPS} SELECT user_id, crop, line, CAST(row_number() OVER (PARTITION BY user_id, crop ORDER BY f0, line) - 1 AS INTEGER) AS k, f0 - c0 AS at, f1 - c0 AS until FROM c JOIN f USING (user_id) WHERE f0 >= c0 AND f1 <= c0 + n""")
def crop_rows(spark, sf_dir):
    """The lines that lie in each crop whole."""
    f = minute_lines(spark, sf_dir)
    return C.crop_rows(minute_crops(f), f, "user_id", 4000.0)


@query(f"""WITH {CROPS}, x AS (SELECT user_id, crop, greatest(f0 - c0, 0) AS a, least(f1 - c0, n) AS b FROM c JOIN f USING (user_id) WHERE f1 > c0 AND f0 < c0 + n AND NOT (f0 >= c0 AND f1 <= c0 + n)),
    m AS (SELECT DISTINCT user_id, crop, unnest(range(a, b)) AS fr FROM x), r AS (SELECT *, fr - row_number() OVER (PARTITION BY user_id, crop ORDER BY fr) AS run FROM m)
    SELECT user_id, crop, CAST(min(fr) AS BIGINT) AS a, CAST(max(fr) + 1 AS BIGINT) AS b FROM r GROUP BY user_id, crop, run""")
def crop_masks(spark, sf_dir):
    """Runs of frames of lines cut at a crop's edges; the SQL marks single frames."""
    f = minute_lines(spark, sf_dir)
    return C.crop_masks(minute_crops(f), f, "user_id", 4000.0)


@query(f"""WITH {CROPS}, p AS (SELECT c.*, line, f0, row_number() OVER (PARTITION BY user_id, crop ORDER BY f0, line) AS k FROM c JOIN f USING (user_id) WHERE f0 >= c0 AND f1 <= c0 + n),
    e AS (SELECT user_id, crop, c0, n, line, f0, k, unnest(range(-1, line % 4 + 1)) AS j FROM p),
    s AS (SELECT user_id, crop, n, k, j, CASE WHEN j < 0 THEN 1 ELSE (line + j) % 26 + 2 END AS letter, CASE WHEN j >= 0 AND (line + j) % 5 <> 0 THEN f0 + j * 3.0 - c0 END AS s FROM e WHERE j >= 0 OR k > 1),
    b AS (SELECT *, row_number() OVER w - 1 AS pos, coalesce(first_value(s IGNORE NULLS) OVER (PARTITION BY user_id, crop ORDER BY k, j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS t FROM s WINDOW w AS (PARTITION BY user_id, crop ORDER BY k, j))
    SELECT user_id, crop, CAST(pos AS INTEGER) AS pos, CAST(letter AS INTEGER) AS letter, round(max(greatest(0, least(t, n - 0.001))) OVER (PARTITION BY user_id, crop ORDER BY pos), 3) AS at FROM b""")
def crop_letters(spark, sf_dir):
    """The letters of each crop's whole lines with starts shifted, filled in from behind, clipped and never falling."""
    from pyspark.sql.window import Window

    f = minute_lines(spark, sf_dir)
    n = (F.col("line") % 4 + 1).cast("int")
    w = Window.partitionBy("user_id").orderBy("f0", "line")
    lined = f.withColumn("i1", F.sum(n).over(w).cast("int")).withColumn("i0", F.col("i1") - n)
    one = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(((F.col("line") + j) % 26 + 2).cast("int").alias("id"), F.when((F.col("line") + j) % 5 != 0, F.col("f0") + j * 3.0).alias("s")))
    song = lined.groupBy("user_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i0", one.alias("x")))), lambda s: s["x"])).alias("x"))
    letters = song.select("user_id", F.transform("x", lambda s: s["id"]).alias("ids"), F.transform("x", lambda s: s["s"]).alias("starts"))
    return C.crop_letters(minute_crops(f), lined, letters, "user_id", 4000.0).withColumn("at", F.round("at", 3))
