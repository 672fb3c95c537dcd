"""Evaluation queries: vectors, error rates, paired intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import aggregates as A
from ..operators import joins as J
from .base import query, table

LETTERS = "regexp_replace(lower(text), '[^a-z]', '', 'g')"


def line_pairs(spark, sf_dir):
    """(doc_id, lang, line, n, ref, hyp): each line of each document with the next one, letters only; n lines of the document have a next one.

    Pairs are dealt out: comparing two lines costs the product of their lengths, far more than moving them, and a long
    document's pairs would otherwise be one task's.
    """
    lines = F.transform(F.split("text", "\n"), lambda l: F.regexp_replace(F.lower(l), "[^a-z]+", ""))  # noqa: E741
    x = table(spark, sf_dir, "documents").where(F.size(F.split("text", "\n")) > 1).select("doc_id", "lang", lines.alias("l"))
    pairs = F.zip_with(F.slice("l", 1, F.size("l") - 1), F.slice("l", 2, F.size("l") - 1), lambda a, b: F.struct(a.alias("ref"), b.alias("hyp")))
    return x.select("doc_id", "lang", (F.size("l") - 1).alias("n"), F.posexplode(pairs).alias("line", "p")).select("doc_id", "lang", "line", "n", "p.*").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "line")


PAIRS = """l AS (SELECT doc_id, lang, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')) AS l FROM documents),
    i AS (SELECT *, unnest(range(1, len(l))) AS k FROM l), p AS (SELECT doc_id, lang, CAST(k - 1 AS INTEGER) AS line, len(l) - 1 AS n, l[k] AS ref, l[k + 1] AS hyp FROM i)"""


@query(f"WITH {PAIRS} SELECT doc_id, line, round(levenshtein(hyp, ref) / greatest(length(ref), 1), 6) AS cer FROM p")
def letter_cer(spark, sf_dir):
    """Each line against the next, as a reading of it."""
    return line_pairs(spark, sf_dir).select("doc_id", "line", F.round(V.letter_error(F.col("hyp"), F.col("ref")), 6).alias("cer"))


@query(f"WITH {PAIRS} SELECT lang, round(sum(levenshtein(hyp, ref)) / greatest(sum(length(ref)), 1), 6) AS micro, round(avg(levenshtein(hyp, ref) / greatest(length(ref), 1)), 6) AS macro, count(*) AS n FROM p GROUP BY 1")
def micro_cer_by_language(spark, sf_dir):
    p = line_pairs(spark, sf_dir).withColumn("e", V.edits("hyp", "ref")).withColumn("n", F.length("ref"))
    return p.groupBy("lang").agg(F.round(A.micro_ratio("e", "n"), 6).alias("micro"), F.round(F.avg(F.col("e") / F.greatest("n", F.lit(1))), 6).alias("macro"), F.count("*").alias("n"))


@query(f"WITH {PAIRS} SELECT doc_id, CAST(3 * line // n AS INTEGER) AS third, CAST(sum(levenshtein(hyp, ref)) AS BIGINT) AS edits, round(sum(levenshtein(hyp, ref)) / greatest(sum(length(ref)), 1), 6) AS micro FROM p GROUP BY 1, 2")
def thirds_micro(spark, sf_dir):
    """Edits over lengths in each third of a document's lines."""
    p = line_pairs(spark, sf_dir).withColumn("third", F.floor(3 * F.col("line") / F.col("n")).cast("int")).select("doc_id", "third", V.edits("hyp", "ref").alias("e"), F.length("ref").alias("m"))
    return p.groupBy("doc_id", "third").agg(F.sum("e").alias("edits"), F.round(A.micro_ratio("e", "m"), 6).alias("micro"))


@query("""WITH e AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 25 = 0 OR TRUE), n AS (SELECT *, count(*) OVER (PARTITION BY label, vec_id // 20) AS n FROM e)
    SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cos
    FROM n a JOIN n b ON a.label = b.label AND a.vec_id // 20 = b.vec_id // 20 AND a.vec_id < b.vec_id WHERE a.n BETWEEN 2 AND 40 AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.2""")
def group_cosine_pairs(spark, sf_dir):
    """Pairs alike within small groups (label and range of ids), at most 40 rows each."""
    e = table(spark, sf_dir, "embeddings").withColumn("g", F.concat_ws(":", "label", F.floor(F.col("vec_id") / 20)))
    p = J.pairs_within(e, "g", "vec_id", 40).select(F.col("a.vec_id").alias("a_id"), F.col("b.vec_id").alias("b_id"), V.cosine("a.embedding", "b.embedding").alias("c"))
    return p.where("c > 0.2").select("a_id", "b_id", F.round("c", 5).alias("cos"))


@query("""WITH s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), m AS (SELECT vec_id, e, list_avg(e) AS mu, list_stddev_pop(e) AS sd FROM s)
    SELECT vec_id, round(mu, 5) AS mean, round(list_max(list_transform(e, lambda x: (x - mu) / (sd + 1e-6))), 2) AS top FROM m""")
def z_scored(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(V.total(F.transform("embedding", lambda x: x.cast("double"))) / F.size("embedding"), 5).alias("mean"), F.round(F.array_max(V.z_scores("embedding", digits=6)), 2).alias("top"))


@query("""WITH s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, CAST(lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS DOUBLE[]) AS b FROM embeddings)
    SELECT vec_id, round(list_avg(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))), 5) AS mad, round(list_avg(list_transform(range(1, 65), lambda i: (a[i] - b[i]) * (a[i] - b[i]))), 5) AS mse FROM s WHERE b IS NOT NULL""")
def vector_differences(spark, sf_dir):
    from pyspark.sql.window import Window

    s = table(spark, sf_dir, "embeddings").withColumn("b", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("b is not null")
    return s.select("vec_id", F.round(V.mean_abs_diff("embedding", "b"), 5).alias("mad"), F.round(V.mse("embedding", "b"), 5).alias("mse"))


@query("SELECT round(corr(o_totalprice, o_orderkey), 6) AS r, count(*) AS n FROM orders")
def pearson(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.round(F.corr("o_totalprice", "o_orderkey"), 6).alias("r"), F.count("*").alias("n"))


@query("SELECT round(avg(d), 4) AS mean, round(stddev_pop(d), 4) AS sd, round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 6) AS above FROM (SELECT l_quantity - l_linenumber * 5 AS d FROM lineitem)")
def gap_statistics(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") - F.col("l_linenumber") * 5).alias("d"))
    return d.agg(F.round(F.avg("d"), 4).alias("mean"), F.round(F.stddev_pop("d"), 4).alias("sd"), F.round(F.avg((F.col("d") > 0).cast("double")), 6).alias("above"))


#: Differences of the lengths of neighbouring lines; counts in each draw by the hash and the tables that the library has.
BOOTSTRAP = f"""WITH {PAIRS}, c AS (SELECT length(hyp) - length(ref) AS cell, count(*) AS n FROM p GROUP BY 1),
    t(few, steps) AS (VALUES {", ".join(f"({n}, {A.poisson_steps(n)})" for n in range(1, A.EXACT_COUNTS + 1))}),
    h AS (SELECT cell, n, draw, md5('b|' || cell || '|' || draw) AS h FROM c, (SELECT unnest(range(1, 301)) AS draw)),
    u AS (SELECT cell, n, draw, (CAST('0x' || substr(h, 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u, (CAST('0x' || substr(h, 9, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS v FROM h),
    d AS (SELECT draw, cell, CASE WHEN few IS NULL THEN CAST(greatest(0, round(n + sqrt(n) * sqrt(-2 * ln(u)) * cos(2 * pi() * v))) AS BIGINT) ELSE len(list_filter(steps, lambda s: u >= s)) END AS w FROM u LEFT JOIN t ON few = n),
    x AS (SELECT draw, cell, w, sum(w) OVER (PARTITION BY draw ORDER BY cell) AS upto, sum(w) OVER (PARTITION BY draw) AS total FROM d WHERE w > 0),
    m AS (SELECT draw, sum(cell * w) / max(total) AS mean,
                 (max(CASE WHEN upto >= (total + 1) // 2 AND upto - w < (total + 1) // 2 THEN cell END) + max(CASE WHEN upto >= total // 2 + 1 AND upto - w < total // 2 + 1 THEN cell END)) / 2.0 AS median FROM x GROUP BY 1),
    ci AS (SELECT quantile_cont(CASE WHEN draw <= 200 THEN mean END, 0.025) AS mean_low, quantile_cont(CASE WHEN draw <= 200 THEN mean END, 0.975) AS mean_high,
                 quantile_cont(CAST(median AS DOUBLE), 0.025) AS median_low, quantile_cont(CAST(median AS DOUBLE), 0.975) AS median_high FROM m)
    SELECT count(*) AS n, CAST(count(*) FILTER (hyp_n < ref_n) AS BIGINT) AS better, CAST(count(*) FILTER (hyp_n > ref_n) AS BIGINT) AS worse, round(avg(hyp_n - ref_n), 6) AS mean, CAST(median(hyp_n - ref_n) AS DOUBLE) AS median,
           round(any_value(mean_low), 6) AS mean_low, round(any_value(mean_high), 6) AS mean_high, any_value(median_low) AS median_low, any_value(median_high) AS median_high
    FROM (SELECT length(hyp) AS hyp_n, length(ref) AS ref_n FROM p), ci"""


@query(BOOTSTRAP)
def paired_bootstrap(spark, sf_dir):
    """Mean and median difference of neighbouring lines' lengths with 95 % intervals by hashed resampling (200 and 300 draws)."""
    d = line_pairs(spark, sf_dir).select((F.length("hyp") - F.length("ref")).cast("double").alias("d"))
    out = A.bootstrap_intervals(d, "d", 200, 300, step=1.0)
    return out.select("n", "better", "worse", F.round("mean", 6).alias("mean"), "median", F.round("mean_low", 6).alias("mean_low"), F.round("mean_high", 6).alias("mean_high"), "median_low", "median_high")


@query("SELECT p_size AS level, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY 1")
def level_histogram(spark, sf_dir):
    return A.shares(table(spark, sf_dir, "part").withColumn("level", F.col("p_size")), "level").select("level", "n", F.round("p", 6).alias("share"))
