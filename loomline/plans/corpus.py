"""Corpus queries: text and hash columns, filters, joins, aggregates, sampling. documents stand for songs:
text for lyrics, source for the creator, n_chars for the duration."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import joins as J
from ..operators import sampling as O
from .base import query, table

HASH = "md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')))"
HEX8 = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
ID = "CAST(doc_id AS VARCHAR)"
BARE = "length(trim(regexp_replace(text, '\\[[^\\]]*\\]', '', 'g')))"
REASON = f"CASE WHEN n_chars < 60 THEN 'too_short' WHEN n_chars > 8000 THEN 'too_long' WHEN {BARE} < 20 THEN 'instrumental' END"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def reasons():
    return {"too_short": F.col("n_chars") < 60, "too_long": F.col("n_chars") > 8000, "instrumental": T.is_instrumental(F.col("text"))}


@query(f"""
    WITH d AS (SELECT *, {HASH} AS h, {REASON} AS reason, {HEX8.format(ID)} / 4294967295.0 AS b FROM documents),
    k AS (SELECT * FROM d WHERE reason IS NULL), t AS (SELECT * FROM k WHERE b >= 0.05), v AS (SELECT * FROM k WHERE b < 0.05),
    g AS (SELECT h, count(*) AS c FROM k GROUP BY h)
    SELECT (SELECT count(*) FROM d) AS n_rows, (SELECT count(*) FROM k) AS n_kept, (SELECT count(*) FROM t) AS n_train,
      (SELECT count(*) FROM v WHERE h NOT IN (SELECT h FROM t)) AS n_val, (SELECT count(*) FROM v WHERE h IN (SELECT h FROM t)) AS n_leak,
      (SELECT CAST(sum(c - 1) AS BIGINT) FROM g) AS n_repeats, (SELECT max(c) FROM g) AS largest_group,
      (SELECT round(quantile_cont(n_chars, 0.5), 6) FROM k) AS p50, (SELECT round(quantile_cont(n_chars, 0.95), 6) FROM k) AS p95,
      (SELECT round(sum(n_chars) / 3600.0, 6) FROM k) AS hours""")
def manifest_summary(spark, sf_dir):
    """The flagship: reasons to drop, split by hash, leak control, duplicate groups, percentiles."""
    d = docs(spark, sf_dir).select("doc_id", "n_chars", T.collapsed_hash(F.col("text")).alias("h"), P.first_reason(reasons()).alias("reason"), T.bucket_closed(F.col("doc_id").cast("string")).alias("b"))
    kept, val = F.col("reason").isNull(), F.col("b") < 0.05
    # copies are counted once, by hash, split and length; all that is asked for follows from the counts
    alike = d.groupBy("h", "n_chars", kept.alias("kept"), val.alias("val")).agg(F.count("*").alias("c"))
    of_hash = Window.partitionBy("h")
    taken = F.when(F.col("kept"), F.col("c"))
    x = alike.withColumn("size", F.sum(taken).over(of_hash)).withColumn("trained", F.sum(F.when(~F.col("val"), taken)).over(of_hash)).withColumn("first", F.row_number().over(of_hash.orderBy("n_chars", "kept", "val")) == 1)
    held = F.when(F.col("val"), taken)
    leak = F.col("h").isNotNull() & (F.col("trained") > 0)
    total = lambda v: F.coalesce(F.sum(v), F.lit(0)).cast("long")
    of = lambda p: F.round(F.percentile(F.when(F.col("kept"), F.col("n_chars")), p, F.col("c")), 6)
    return x.agg(
        F.sum("c").alias("n_rows"), total(taken).alias("n_kept"), total(F.when(~F.col("val"), taken)).alias("n_train"), total(F.when(~F.coalesce(leak, F.lit(False)), held)).alias("n_val"), total(F.when(leak, held)).alias("n_leak"),
        F.sum(F.when(F.col("first"), F.col("size") - 1)).alias("n_repeats"), F.max("size").alias("largest_group"), of(0.5).alias("p50"), of(0.95).alias("p95"), F.round(F.sum(taken * F.col("n_chars")) / 3600.0, 6).alias("hours"),
    )


@query(f"SELECT coalesce({REASON}, 'kept') AS reason, count(*) AS n FROM documents GROUP BY 1")
def drop_reasons(spark, sf_dir):
    return P.reason_counts(docs(spark, sf_dir), reasons())


@query(f"SELECT doc_id, {BARE} < 20 AS instrumental FROM documents")
def instrumental_flag(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.is_instrumental(F.col("text")).alias("instrumental"))


@query(f"SELECT h, c, first_id FROM (SELECT {HASH} AS h, count(*) AS c, min(doc_id) AS first_id FROM documents GROUP BY 1) WHERE c > 1")
def lyric_hash_dups(spark, sf_dir):
    return A.duplicate_groups(docs(spark, sf_dir).withColumn("h", T.collapsed_hash(F.col("text"))), "h", "doc_id")


@query("SELECT h, c, first_id FROM (SELECT md5(lower(trim(text, ' \n\r\t'))) AS h, count(*) AS c, min(doc_id) AS first_id FROM documents GROUP BY 1) WHERE c > 1")
def strip_hash_dups(spark, sf_dir):
    return A.duplicate_groups(docs(spark, sf_dir).withColumn("h", T.stripped_hash(F.col("text"))), "h", "doc_id")


@query(f"SELECT doc_id, round({HEX8.format('source')} / 4294967295.0, 9) AS closed, round({HEX8.format(ID + " || 'whole'")} / 4294967296.0, 9) AS open, {HEX8.format(ID + " || 'whole'")} / 4294967296.0 < 0.3 AS kept FROM documents")
def creator_split(spark, sf_dir):
    salted = T.bucket_open(F.concat(F.col("doc_id").cast("string"), F.lit("whole")))
    return docs(spark, sf_dir).select("doc_id", F.round(T.bucket_closed(F.col("source")), 9).alias("closed"), F.round(salted, 9).alias("open"), (salted < 0.3).alias("kept"))


@query(f"""SELECT doc_id, CAST(m AS BIGINT) AS m, CASE WHEN m < 5 THEN 'test' WHEN m < 10 THEN 'dev' ELSE 'train' END AS split, CAST(m20 AS BIGINT) AS m20 FROM (
    SELECT doc_id, CAST(('0x' || md5({ID})) AS UHUGEINT) % 1000 AS m, CAST(('0x' || md5({ID})) AS UHUGEINT) % 20 AS m20 FROM documents)""")
def split_mod1000(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    return docs(spark, sf_dir).select("doc_id", T.md5_mod(i, 1000).alias("m"), T.split_of(i).alias("split"), T.md5_mod(i, 20).alias("m20"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def train_antijoin(spark, sf_dir):
    return docs(spark, sf_dir).join(table(spark, sf_dir, "labels").where("quality = 0"), "doc_id", "left_anti").select("doc_id")


@query("SELECT d.doc_id, l.quality, l.doc_id IS NULL AS unscanned FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def scan_join(spark, sf_dir):
    return J.with_miss_flag(docs(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "unscanned")


@query("SELECT count(*) AS n_rows, count(l.doc_id) AS n_found, count(*) - count(l.doc_id) AS n_missed FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def join_miss_counts(spark, sf_dir):
    rows = J.with_miss_flag(docs(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "missed")
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(~F.col("missed")).alias("n_found"), F.count_if("missed").alias("n_missed"))


@query(f"""WITH d AS (SELECT doc_id, {HASH} AS h, {HEX8.format(ID)} / 4294967295.0 < 0.05 AS val FROM documents)
    SELECT doc_id, val, val AND h IN (SELECT h FROM d WHERE NOT val) AS leaked, h IN (SELECT {HASH} FROM benchmark) AS held_out FROM d""")
def leak_antijoin(spark, sf_dir):
    """Leak control by the hash of the whole text: validation rows whose text is in train too, and documents that are a held-out item."""
    hashed = T.collapsed_hash(F.col("text"))
    d = docs(spark, sf_dir).select("doc_id", hashed.alias("h"), (T.bucket_closed(F.col("doc_id").cast("string")) < 0.05).alias("val"))
    d = J.membership(d, d.where("not val"), "h", "in_train")
    d = J.membership(d, table(spark, sf_dir, "benchmark").select(hashed.alias("h")), "h", "held_out")
    return d.select("doc_id", "val", F.expr("val and in_train").alias("leaked"), "held_out")


@query("""SELECT doc_id, CASE WHEN cjk + cyr + lat = 0 THEN 'none' WHEN cjk / (cjk + cyr + lat) > 0.3 THEN 'cjk' WHEN cyr / (cjk + cyr + lat) > 0.3 THEN 'cyrillic' ELSE 'latin' END AS script FROM (
    SELECT doc_id, len(regexp_extract_all(text, '[\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}]')) AS cjk, len(regexp_extract_all(text, '[\\x{0400}-\\x{04FF}]')) AS cyr, len(regexp_extract_all(text, '[A-Za-z]')) AS lat FROM documents)""")
def script_mix(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.script_of(F.col("text")).alias("script"))


@query("SELECT CASE WHEN text = '' THEN 'none' WHEN regexp_matches(text, '[a-zA-Z]') THEN 'latin' ELSE 'other' END AS script, count(*) AS n FROM documents GROUP BY 1")
def lang_majority(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(T.script_majority(F.col("text")).alias("script")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'english' ELSE '' END AS language, CASE WHEN regexp_matches(text, '\\p{L}') THEN 'und' ELSE '' END AS iso FROM documents")
def language_rules(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.caption_language(F.col("text")).alias("language"), T.iso_language(F.col("text")).alias("iso"))


@query("SELECT t AS title, count(*) AS n FROM (SELECT regexp_replace(lower(p_name), '[\\s\\-_·.,''\"!?，。！？、:：;；/\\\\()（）\\[\\]【】]+', '', 'g') AS t FROM part) GROUP BY 1")
def norm_title_groups(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(T.norm_title(F.col("p_name")).alias("title")).agg(F.count("*").alias("n"))


@query("""SELECT title, n, CAST(sum(n) OVER () AS BIGINT) AS covered FROM (SELECT lower(p_brand) AS title, count(*) AS n FROM part GROUP BY 1) WHERE n > 1 ORDER BY n DESC, title LIMIT 20""")
def dup_title_topk(spark, sf_dir):
    return A.top_duplicates(table(spark, sf_dir, "part").select(F.lower("p_brand").alias("title")), "title", 20)


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT n / (SELECT sum(n) FROM c) AS p FROM c)
    SELECT round(-sum(p * log2(p)), 6) AS bits, count(*) AS kinds FROM p""")
def artist_entropy(spark, sf_dir):
    return A.entropy(docs(spark, sf_dir), "source").select(F.round("bits", 6).alias("bits"), "kinds")


@query("""WITH c AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS r FROM documents GROUP BY 1)
    SELECT round(sum(CASE WHEN r <= 1 THEN n END) / sum(n), 6) AS top1, round(sum(CASE WHEN r <= 5 THEN n END) / sum(n), 6) AS top5 FROM c""")
def top_share(spark, sf_dir):
    return A.top_shares(docs(spark, sf_dir), "source", (1, 5))


@query("""SELECT source, x[least(n, CAST(floor(0.5 * n) AS BIGINT) + 1)] AS p50, x[least(n, CAST(floor(0.95 * n) AS BIGINT) + 1)] AS p95 FROM (SELECT source, list_sort(list(n_chars)) AS x, count(*) AS n FROM documents GROUP BY 1)""")
def nearest_rank_quantiles(spark, sf_dir):
    return A.nearest_rank(docs(spark, sf_dir), "source", "n_chars", {"p50": 0.5, "p95": 0.95})


@query("SELECT source, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(median(n_chars), 6) AS mid FROM documents GROUP BY 1")
def linear_percentiles(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source").agg(F.round(A.linear_percentile("n_chars", 0.5), 6).alias("p50"), F.round(A.linear_percentile("n_chars", 0.95), 6).alias("p95"), F.round(F.median("n_chars"), 6).alias("mid"))


@query("""WITH x AS (SELECT lang, n_chars AS v, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents),
    k AS (SELECT lang, n, unnest(range(1, 10)) AS d FROM (SELECT DISTINCT lang, n FROM x)),
    q AS (SELECT lang, d, greatest(1, least(n - 1, (d * (n + 1)) // 10)) AS j, n FROM k)
    SELECT q.lang, CAST(d AS INTEGER) AS decile, round((a.v * (10 - (d * (n + 1) - j * 10)) + b.v * (d * (n + 1) - j * 10)) / 10, 6) AS v
    FROM q JOIN (SELECT lang, r, v FROM x) a ON a.lang = q.lang AND a.r = j JOIN (SELECT lang, r, v FROM x) b ON b.lang = q.lang AND b.r = j + 1""")
def exclusive_deciles(spark, sf_dir):
    return A.exclusive_quantiles(docs(spark, sf_dir), "lang", "n_chars", 10).select("lang", F.col("k").alias("decile"), F.round("v", 6).alias("v"))


FLAGS = "list_filter([CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN n_chars > 6000 THEN 'long' END, CASE WHEN regexp_matches(text, '(?i)licen[cs]e|copyright') THEN 'junk' END, CASE WHEN regexp_matches(text, '[\\w.-]+@[\\w-]+\\.\\w+') THEN 'mail' END], lambda x: x IS NOT NULL)"


def flagged(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("flags", P.flags({"short": F.col("n_chars") < 500, "long": F.col("n_chars") > 6000, "junk": F.col("text").rlike("(?i)licen[cs]e|copyright"), "mail": F.col("text").rlike("[\\w.-]+@[\\w-]+\\.\\w+")}))


@query(f"SELECT doc_id, array_to_string({FLAGS}, ',') AS flags FROM documents")
def flag_array(spark, sf_dir):
    return flagged(spark, sf_dir).select("doc_id", F.array_join("flags", ",").alias("flags"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {FLAGS} AS f FROM documents) WHERE NOT list_has_any(f, ['junk', 'long'])")
def flag_overlap_filter(spark, sf_dir):
    return flagged(spark, sf_dir).where(P.has_none("flags", ["junk", "long"])).select("doc_id")


@query(f"""WITH d AS (SELECT *, {FLAGS} AS f FROM documents), l AS (
      SELECT 'lang:' || lang AS key, n_chars FROM d UNION ALL SELECT 'src:' || source, n_chars FROM d UNION ALL SELECT 'flag:' || unnest(f), n_chars FROM d)
    SELECT key, count(*) AS n, round(sum(n_chars) / 3600.0, 6) AS hours FROM l GROUP BY 1""")
def long_counters(spark, sf_dir):
    return A.long_counters(flagged(spark, sf_dir), {"lang": "lang", "src": "source"}, {"flag": "flags"}, "n_chars")


@query(f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5({ID}), doc_id) AS r, count(*) OVER (PARTITION BY source) AS c, count(*) OVER () AS t FROM documents)
    SELECT doc_id, source FROM d WHERE r <= greatest(1, CAST(round_even(100.0 * c / t, 0) AS BIGINT))""")
def stratified_sample(spark, sf_dir):
    return O.stratified(docs(spark, sf_dir), "source", "doc_id", 100).select("doc_id", "source")


@query(f"SELECT doc_id FROM documents ORDER BY md5({ID}), doc_id LIMIT 40 OFFSET 10")
def hash_ordered_sample(spark, sf_dir):
    return O.hash_order(docs(spark, sf_dir), "doc_id").offset(10).limit(40).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE {HEX8.format(ID + " || 'ex'")} / 4294967296.0 < 0.2")
def bernoulli_sample(spark, sf_dir):
    return O.bernoulli(docs(spark, sf_dir), "doc_id", 0.2, "ex").select("doc_id")


@query("""WITH w AS (SELECT doc_id, round(least(1.0, 300.0 / na, 100.0 / nl), 4) AS w FROM (
      SELECT doc_id, count(*) OVER (PARTITION BY lang) AS na, count(*) OVER (PARTITION BY source) AS nl FROM documents)) SELECT * FROM w""")
def artist_album_weights(spark, sf_dir):
    return O.group_weights(docs(spark, sf_dir), {"lang": 300, "source": 100}).select("doc_id", F.round("w", 4).alias("w"))


@query("""WITH s AS (SELECT *, n_chars - lag(n_chars) OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS gap FROM documents),
    c AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS k FROM s)
    SELECT doc_id, CAST(k AS BIGINT) AS cluster, CASE WHEN first_value(doc_id) OVER w = doc_id THEN NULL ELSE first_value(doc_id) OVER w END AS dup_of
    FROM c WINDOW w AS (PARTITION BY lang, source, k ORDER BY n_chars DESC, doc_id)""")
def duration_cluster_dups(spark, sf_dir):
    """Single-link clusters by length within a group, and a survivor of each."""
    d = J.single_link(docs(spark, sf_dir), ["lang", "source"], "n_chars", "doc_id", 20)
    return J.survivor(d, ["lang", "source", "cluster"], [F.col("n_chars").desc(), F.col("doc_id")], "doc_id").select("doc_id", "cluster", "dup_of")


@query("SELECT l_returnflag, count(DISTINCT l_shipdate) + CASE WHEN bool_or(l_shipdate IS NULL) THEN 1 ELSE 0 END AS n FROM lineitem GROUP BY 1")
def distinct_with_null(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(A.distinct_with_null("l_shipdate").alias("n"))


@query("""SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS share, round(avg(value), 4) AS mean,
    round(stddev_pop(value), 4) AS sd FROM events GROUP BY 1""")
def conditional_shares(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("share"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("sd"))


@query("SELECT word, n, round(sum(n) OVER (ORDER BY n DESC, word) / t, 6) AS coverage FROM (SELECT word, count(*) AS n, sum(count(*)) OVER () AS t FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY 1) ORDER BY n DESC, word LIMIT 50")
def vocabulary_coverage(spark, sf_dir):
    return A.vocabulary(docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")), "word", 50)


@query("SELECT split_part(o_orderpriority, '-', 1) AS class, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, class LIMIT 5")
def failure_classes(spark, sf_dir):
    return A.top_counts(table(spark, sf_dir, "orders").select(F.substring_index("o_orderpriority", "-", 1).alias("class")), "class", 5)


@query("SELECT o_custkey, CAST(min_by(o_orderkey, (o_totalprice, o_orderkey)) AS BIGINT) AS loser, CAST(max_by(o_orderkey, (o_totalprice, -o_orderkey)) AS BIGINT) AS winner FROM orders GROUP BY 1 HAVING max(o_totalprice) - min(o_totalprice) >= 100000")
def preference_pairs(spark, sf_dir):
    return A.preference_pairs(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice", 100000.0)


@query("SELECT l_orderkey, round((sum(l_quantity) OVER w - l_quantity) / nullif(count(*) OVER w - 1, 0), 6) AS others, l_linenumber FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def leave_one_out(spark, sf_dir):
    return A.leave_one_out(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", "others").select("l_orderkey", F.round("others", 6).alias("others"), "l_linenumber")


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' UNION ALL SELECT item_id, 'benchmark' FROM benchmark")
def union_sources(spark, sf_dir):
    return docs(spark, sf_dir).where("lang = 'en'").select("doc_id", "source").unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("benchmark").alias("source")))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def intersect_ids(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT DISTINCT lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) AS k FROM documents")
def distinct_keys(spark, sf_dir):
    return docs(spark, sf_dir).select(T.norm_letters(F.col("text")).alias("k")).distinct()


@query("SELECT d.doc_id, quality, c.turns FROM documents d JOIN labels USING (doc_id) JOIN (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1) c ON c.conv_id = d.doc_id")
def three_way_join(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("turns"))
    return docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").join(turns, "doc_id")


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS h, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM pages")
def html_escaped(spark, sf_dir):
    """Whole pages escaped for a report."""
    return table(spark, sf_dir, "pages").select("page_id", T.html_escape(F.col("html")).alias("h"), T.slug(F.col("url")).alias("s"))


@query("SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE NOT regexp_matches(line, '(?i)[©℗]|https?://|www\\.|\\b[\\w.-]+@[\\w-]+\\.\\w+|\\b[\\w-]+\\.(com|cn|net|org)\\b') AND trim(line) <> ''")
def notice_lines(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(~F.col("line").rlike("(?iU)[©℗]|https?://|www\\.|\\b[\\w.-]+@[\\w-]+\\.\\w+|\\b[\\w-]+\\.(com|cn|net|org)\\b") & (F.trim("line") != ""))
