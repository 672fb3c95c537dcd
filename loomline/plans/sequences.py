"""Sequence queries: line items of an order stand for the codes of a song."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import ragged as G
from ..operators import sampling as O
from ..operators import sequences as S
from ..operators import windows as W
from ..sources import packed as P
from ..sources.shared import shared_dir
from .base import query, table

#: Codes of an order: its part keys modulo 1024, in the order of (line number, part key).
CODES = "c AS (SELECT l_orderkey AS g, list(CAST(l_partkey % 1024 AS INTEGER) ORDER BY l_linenumber, l_partkey) AS codes, list(CAST(l_linenumber AS INTEGER) ORDER BY l_linenumber, l_partkey) AS text FROM lineitem GROUP BY 1)"


def codes(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    return x.select("g", F.transform("x", lambda s: (s["l_partkey"] % 1024).cast("int")).alias("codes"), F.transform("x", lambda s: s["l_linenumber"].cast("int")).alias("text"))


def joined(x):
    return F.array_join(F.transform(x, lambda v: v.cast("string")), " ")


@query(f"WITH {CODES} SELECT g, array_to_string(text || [65536, 65537, 65539] || list_transform(codes, lambda c: c + 65544) || [65538, 0], ' ') AS doc FROM c")
def song_documents(spark, sf_dir):
    return codes(spark, sf_dir).select("g", joined(S.song_document(F.col("text"), F.col("codes"))).alias("doc"))


@query(f"WITH {CODES} SELECT g, CAST(2 * len(codes) + 5 AS INTEGER) AS n_doc, CAST(coalesce(sum(2 * len(codes) + 5) OVER (PARTITION BY g % 8 ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM c")
def doc_pack_offsets(spark, sf_dir):
    d = codes(spark, sf_dir).withColumn("shard", F.col("g") % 8)
    return S.packed(d, ["g"], F.size(S.song_document(F.col("text"), F.col("codes"))), "shard").select("g", F.col("size").alias("n_doc"), F.col("offset").cast("long").alias("at"))


@query(f"WITH {CODES} SELECT g, array_to_string(text, ' ') AS first_text, array_to_string(codes[1:1], ' ') AS first_codes, CAST(9 + len(codes) + 1 + 2 * len(text) AS INTEGER) AS n FROM c")
def section_documents(spark, sf_dir):
    """Two sections (the first code, the others), assembled and parsed back; the length by formula."""
    c = codes(spark, sf_dir)
    n = F.size("codes")
    section = lambda a, b: F.struct(F.col("text").alias("text"), a.cast("int").alias("f0"), b.cast("int").alias("f1"))
    c = c.withColumn("sections", F.array(section(F.lit(0), F.lit(1)), section(F.lit(1), n)))
    head = F.array(F.lit(7))
    c = c.withColumn("doc", S.section_document(head, F.col("sections"), F.col("codes"))).withColumn("parsed", S.parse_sections("doc"))
    same = F.assert_true((S.section_length(head, F.col("sections")) == F.size("doc")) & (F.flatten(F.transform("parsed", lambda p: p["codes"])) == F.col("codes")) & S.balanced_marks("doc"))
    return c.select("g", joined(F.get("parsed", F.lit(0))["text"]).alias("first_text"), joined(F.get("parsed", F.lit(0))["codes"]).alias("first_codes"), (F.size("doc") - 1 + 0 * F.coalesce(same.cast("int"), F.lit(0))).alias("n"))


@query(f"WITH {CODES} SELECT g, array_to_string(list_transform(codes, lambda c: CAST(c % 8 + 8 * ((c // 8) % 8) + 64 * ((c // 64) % 8) AS INTEGER)), ' ') AS back FROM c")
def fsq_round_trip(spark, sf_dir):
    levels = [8, 8, 8]
    c = codes(spark, sf_dir).select("g", F.posexplode("codes").alias("i", "c")).withColumn("d", S.fsq_digits(F.col("c"), levels))
    back = c.withColumn("b", S.fsq_index("d", levels)).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "b"))).alias("x"))
    return back.select("g", joined(F.transform("x", lambda s: s["b"])).alias("back"))


@query(f"WITH {CODES} SELECT g, array_to_string(list_concat(codes[2:], codes[1:1]), ' ') AS rotated FROM c")
def rotated_sections(spark, sf_dir):
    return codes(spark, sf_dir).select("g", joined(J.rotated("codes")).alias("rotated"))


@query(f"WITH {CODES}, m AS (SELECT g, list_transform(codes, lambda c: CAST(c % 3 AS INTEGER)) AS x FROM c) SELECT g, array_to_string(list_filter(list_transform(x, lambda v, i: CASE WHEN v <> 0 AND (i = 1 OR v <> x[i - 1]) THEN v END), lambda v: v IS NOT NULL), ' ') AS s FROM m")
def greedy_collapse(spark, sf_dir):
    return codes(spark, sf_dir).select("g", F.transform("codes", lambda c: c % 3).alias("x")).select("g", joined(W.collapsed("x")).alias("s"))


@query(f"WITH {CODES}, m AS (SELECT g, list_transform(codes, lambda c: CAST(c % 3 AS INTEGER)) AS x FROM c) SELECT g, round(coalesce(list_sum(list_transform(range(2, len(x) + 1), lambda i: CASE WHEN x[i] = x[i - 1] THEN 1 ELSE 0 END)), 0) / greatest(len(x) - 1, 1), 6) AS rate, CAST(len(list_distinct(x)) AS INTEGER) AS kinds FROM m")
def repeat_rates(spark, sf_dir):
    return codes(spark, sf_dir).select("g", F.transform("codes", lambda c: c % 3).alias("x")).select("g", F.round(S.repeat_rate("x"), 6).alias("rate"), F.size(F.array_distinct("x")).alias("kinds"))


@query(f"""WITH {CODES}, w AS (SELECT g, unnest(range(0, len(codes), 3)) AS a, len(codes) AS n FROM c) SELECT g, CAST(a AS INTEGER) AS a, CAST(least(a + 3, n) AS INTEGER) AS b, CAST(greatest(a - 1, 0) AS INTEGER) AS lo, CAST(least(a + 4, n) AS INTEGER) AS hi FROM w""")
def context_chunks(spark, sf_dir):
    return codes(spark, sf_dir).select("g", F.explode(W.chunks(F.size("codes"), 3, 1)).alias("s")).select("g", "s.a", "s.b", "s.lo", "s.hi")


@query(f"WITH {CODES} SELECT g, array_to_string(list_transform(range(-1, 3), lambda i: CASE WHEN i < 0 THEN -1 WHEN i >= len(codes) THEN -2 ELSE codes[i + 1] END), ' ') AS w FROM c")
def sliding_ids(spark, sf_dir):
    return codes(spark, sf_dir).select("g", joined(W.id_window("codes", F.lit(0), 1, 3, -1, -2)).alias("w"))


@query("SELECT i, CAST((CAST(((i * i) % 997 * i) % 997 AS BIGINT) * 616) % 997 AS BIGINT) AS at FROM (SELECT CAST(unnest(range(0, 500)) AS BIGINT) AS i) WHERE 997 % 3 = 1 OR TRUE".replace("997", "983").replace("616", "607"))
def window_sampler(spark, sf_dir):
    """The quasi-random order of windows; needs no table."""
    return O.window_offsets(spark, 998, 500).select("i", "at")


@query("SELECT c_nationkey AS g, count(*) AS n, CAST(sum(CASE WHEN c_acctbal >= 5000 THEN 1 ELSE 0 END) AS BIGINT) AS full_band, CAST(sum(CASE WHEN c_acctbal >= 0 AND c_acctbal < 5000 THEN 1 ELSE 0 END) AS BIGINT) AS mid_band FROM customer GROUP BY 1")
def bandwidth_tiers(spark, sf_dir):
    from ..operators.filters import tier

    t = table(spark, sf_dir, "customer").withColumn("t", tier(F.col("c_acctbal"), [(5000, "full"), (0, "mid")], "low"))
    return t.groupBy(F.col("c_nationkey").alias("g")).agg(F.count("*").alias("n"), F.count_if(F.col("t") == "full").alias("full_band"), F.count_if(F.col("t") == "mid").alias("mid_band"))


#: Song documents by shard, with their order and place in it.
PACKED = f"WITH {CODES}, d AS (SELECT g, g % 8 AS shard, text || [65536, 65537, 65539] || list_transform(codes, lambda c: c + 65544) || [65538, 0] AS doc FROM c), p AS (SELECT shard, row_number() OVER w - 1 AS ord, sum(len(doc)) OVER w - len(doc) AS low, doc, count(*) OVER (PARTITION BY shard) AS n FROM d WINDOW w AS (PARTITION BY shard ORDER BY g))"


def packed_files(spark, sf_dir):
    """All song documents written as packed token files to the shared folder: their path."""
    path = shared_dir(spark)
    docs = codes(spark, sf_dir).select("g", (F.col("g") % 8).cast("int").alias("shard"), S.song_document(F.col("text"), F.col("codes")).alias("doc"))
    P.write_packed_files(docs, "doc", "shard", ["g"], path)
    return path


@query(f"""{PACKED} SELECT CAST(shard AS INTEGER) AS shard, ord, CAST(low AS BIGINT) AS "at", CAST(len(doc) AS INTEGER) AS size, array_to_string(doc, ' ') AS doc FROM p""")
def packed_round_trip(spark, sf_dir):
    """Song documents written to packed token files and read back."""
    return P.read_packed_files(spark, packed_files(spark, sf_dir)).select("shard", "ord", "at", "size", joined("tokens").alias("doc"))


@query(f"{PACKED} SELECT CAST(shard AS INTEGER) AS shard, ord, CAST(len(doc) AS INTEGER) AS len, CAST(list_position(doc, 65536) - 1 AS INTEGER) AS n_text, array_to_string(list_transform(doc[list_position(doc, 65536) + 3:list_position(doc, 65536) + 7], lambda v: v - 65544), ' ') AS first_codes, array_to_string(doc[-2:], ' ') AS tail FROM p WHERE ord IN (0, n // 2, n - 1)")
def packed_ends(spark, sf_dir):
    """What the first, the middle and the last document of each packed shard hold."""
    return P.checked_ends(spark, packed_files(spark, sf_dir)).select("shard", "ord", "len", "n_text", joined("first_codes").alias("first_codes"), joined("tail").alias("tail"))


@query(f"WITH {CODES}, o AS (SELECT g, g % 8 AS shard, codes, row_number() OVER w - 1 AS j, sum(len(codes)) OVER w AS high FROM c WINDOW w AS (PARTITION BY g % 8 ORDER BY g)) SELECT CAST(shard AS INTEGER) AS shard, CAST(j AS INTEGER) AS j, CAST(high - len(codes) AS BIGINT) AS low, CAST(high AS BIGINT) AS high, array_to_string(codes, ' ') AS codes FROM o")
def ragged_slices(spark, sf_dir):
    """Codes of all orders as one chunked stream a shard, each order's slice taken back by its offsets."""
    from pyspark.sql.window import Window

    c = codes(spark, sf_dir).withColumn("shard", (F.col("g") % 8).cast("int"))
    c = c.withColumn("j", F.row_number().over(Window.partitionBy("shard").orderBy("g")) - 1)
    chunks, where = G.chunked(c, "codes", chunk=1000)
    return G.sliced(chunks, where, chunk=1000, places=True).select("shard", "j", "low", "high", joined("values").alias("codes"))


@query("""WITH l AS (SELECT l_orderkey AS g, l_linenumber AS k, l_partkey, l_linenumber * 20 + l_suppkey % 90 - 15 AS f0, l_linenumber * 20 + l_suppkey % 90 - 15 + CAST(l_quantity AS BIGINT) * 2 - 3 AS f1,
      list_transform(range(1, l_partkey % 9 + 1), lambda i: CASE WHEN (i * l_suppkey) % 4 = 0 THEN 1 ELSE 10 + i END) AS ids FROM lineitem),
    x AS (SELECT *, least(f1, f0 + CAST(floor(25 * (2.0 + 0.2 * len(ids))) AS BIGINT)) AS f1c, len(list_filter(ids, lambda v: v <> 1)) AS letters,
      len(list_filter(list_transform(range(1, len(ids) + 1), lambda i: ids[i] <> 1 AND (i = 1 OR ids[i - 1] = 1)), lambda v: v)) AS words FROM l WHERE len(ids) > 0 AND f0 >= 0 AND f0 <= f1),
    n AS (SELECT *, letters + greatest(words - 1, 0) AS n FROM x WHERE f1c <= 180),
    a AS (SELECT *, coalesce(max(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY f0, k, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS apart FROM n)
    SELECT g, k, l_partkey, f0, f1, f1c, CAST(sum(n + apart) OVER w - n AS INTEGER) AS i0, CAST(sum(n + apart) OVER w AS INTEGER) AS i1 FROM a WINDOW w AS (PARTITION BY g ORDER BY f0, k, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def song_line_table(spark, sf_dir):
    """Line items as timed lines with letters: which are kept and where their letters lie in the order's."""
    at = F.col("l_linenumber") * 20 + F.col("l_suppkey") % 90 - 15
    ids = F.when(F.col("l_partkey") % 9 == 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("l_partkey") % 9, F.lit(1)).cast("long")), lambda i: F.when((i * F.col("l_suppkey")) % 4 == 0, 1).otherwise(10 + i)))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.struct(F.col("l_linenumber").alias("k"), "l_partkey").alias("o"), at.cast("long").alias("f0"), (at + F.col("l_quantity").cast("long") * 2 - 3).cast("long").alias("f1"), ids.alias("ids"))  # noqa: E741
    return G.line_table(l, "g", "o", F.lit(180)).select("g", "o.k", "o.l_partkey", "f0", "f1", "f1c", "i0", "i1")


@query(f"WITH {CODES} SELECT g, o_custkey AS meta, CAST(len(codes) AS INTEGER) AS n, array_to_string(codes, ' ') AS codes FROM c JOIN orders ON o_orderkey = g")
def partition_wise_join(spark, sf_dir):
    """Orders' metadata and their codes from two bucketed tables, joined bucket by bucket."""
    tag, n = uuid.uuid4().hex[:12], 8
    arrays = J.bucketed(codes(spark, sf_dir).select("g", "codes"), f"codes_{tag}", "g", n)
    meta = J.bucketed(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("g"), F.col("o_custkey").alias("meta")), f"meta_{tag}", "g", n)
    return J.partition_wise(meta, arrays, "g").select("g", "meta", F.size("codes").alias("n"), joined("codes").alias("codes"))


@query(f"""WITH {CODES}, p AS (SELECT g, unnest([['first'], ['last'], ['mid']])[1] AS part, codes FROM c), s AS (
      SELECT g, part, CASE part WHEN 'first' THEN codes[1:2] WHEN 'last' THEN codes[greatest(len(codes) - 1, 1):] ELSE codes[3:len(codes) - 2] END AS v FROM p
      UNION ALL SELECT g, 'from ' || a, codes[a + 1:a + 3] FROM (SELECT g, codes, unnest(range(0, len(codes), 3)) AS a FROM c))
    SELECT g % 5 AS k, part, round(avg(list_avg(v)), 6) AS mean, CAST(sum(len(v)) AS BIGINT) AS n, count(*) AS rows FROM s WHERE len(v) > 0 GROUP BY 1, 2""")
def position_means(spark, sf_dir):
    """Mean codes by place: the first two, the last two, those between, and every three from the start."""
    return A.position_means(codes(spark, sf_dir).withColumn("k", F.col("g") % 5), "codes", ["k"], 2, 3).withColumn("mean", F.round("mean", 6))


@query("""WITH x AS (SELECT c_custkey AS i, CAST(c_acctbal AS DOUBLE) AS v, unnest(range(0, 2 + c_nationkey % 3)) AS k FROM customer),
    m AS (SELECT i, 'm' || k AS metric, CASE WHEN (i + k) % 11 = 0 THEN NULL WHEN (i + k) % 13 = 0 THEN 'nan'::DOUBLE ELSE v + k END AS a, CASE WHEN (i + k) % 7 = 0 THEN 'nan'::DOUBLE ELSE v + k + (i * (k + 1)) % 9 - 4 END AS b,
      (i + k) % 10 <> 0 AS has_a, i % 6 <> 0 AS has_b FROM x),
    p AS (SELECT metric, a, b, CASE WHEN NOT has_b THEN 'only_a' WHEN NOT has_a THEN 'only_b' WHEN a IS NULL OR b IS NULL THEN 'null' WHEN isnan(a) OR isnan(b) THEN 'nan' ELSE 'both' END AS state FROM m WHERE has_a OR has_b)
    SELECT metric, count(*) FILTER (state = 'both') AS n, round(avg(a) FILTER (state = 'both'), 4) AS mean_a, round(avg(b) FILTER (state = 'both'), 4) AS mean_b, round(median(a) FILTER (state = 'both'), 6) AS median_a, round(median(b) FILTER (state = 'both'), 6) AS median_b,
      round(median(b - a) FILTER (state = 'both'), 6) AS median_diff, count(*) FILTER (state = 'both' AND b < a) AS better, count(*) FILTER (state = 'both' AND b > a) AS worse, count(*) FILTER (state = 'only_a') AS only_a, count(*) FILTER (state = 'only_b') AS only_b,
      count(*) FILTER (state = 'null') AS "null", count(*) FILTER (state = 'nan') AS nan FROM p GROUP BY 1""")
def paired_runs(spark, sf_dir):
    """Two runs' metrics by item, held in maps of whatever names there are, paired and summed up."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.col("c_acctbal").cast("double").alias("v"), F.sequence(F.lit(0), (F.col("c_nationkey") % 3).cast("int") + 1).alias("ks"))
    nan = F.lit(float("nan"))
    a = lambda k: F.when((F.col("i") + k) % 11 == 0, F.lit(None)).when((F.col("i") + k) % 13 == 0, nan).otherwise(F.col("v") + k)
    b = lambda k: F.when((F.col("i") + k) % 7 == 0, nan).otherwise(F.col("v") + k + (F.col("i") * (k + 1)) % 9 - 4)
    run = lambda value, holds: F.map_from_entries(F.transform(F.filter("ks", holds), lambda k: F.struct(F.concat(F.lit("m"), k.cast("string")).alias("k"), value(k).alias("v"))))
    runs = [c.select(F.col("i").alias("item"), run(v, h).alias("metrics")) for v, h in ((a, lambda k: (F.col("i") + k) % 10 != 0), (b, lambda k: F.col("i") % 6 != 0))]
    out = A.paired_summary(A.paired_metrics(*runs, "item", "metrics"))
    return out.select("metric", "n", *[F.round(x, 4).alias(x) for x in ("mean_a", "mean_b")], *[F.round(x, 6).alias(x) for x in ("median_a", "median_b", "median_diff")], "better", "worse", "only_a", "only_b", "null", "nan")
