"""What each filter of a chain does alone, in every order and against the others, from the counts of failure masks.

A document's mask has a bit for each filter that it fails. With x a choice of filters (0 or 1 each), the number of
documents removed is a multilinear polynomial in x whose coefficients follow from the counts of masks, so that one
aggregation of the corpus answers for all orders: corners of the cube give what is left after any steps, and the
integral of a partial derivative along its diagonal gives a filter's Shapley share.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The limits of the five filters.
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_CAPITALS_PCT, SIGNS = 200, 50, 2, "[#$%&*|]"
WORD_BREAK = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text fails A (few words), B (few distinct words), C (many capitals), D (signs). Empty texts fail A alone."""
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PCT * F.size(words),
        "C": 100 * capitals > MOST_CAPITALS_PCT * F.length(text),
        "D": text.rlike(SIGNS),
    }


def mask_of(failures: list[Column]) -> Column:
    """The number whose bit k is set where the k-th filter fails."""
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(failures)), F.lit(0)).cast("int")


def text_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each source by the filters A to E that they fail.

    E is a smaller doc_id with the same text anywhere in docs. Texts are told apart by SHA-256. All that is counted is
    the same for copies of a text with the same source and labels, so these are one row (made before anything is
    shuffled) when the smallest id of a text is looked up: a text that a third of the rows hold is a few rows there.
    Null texts count as empty, null sources as the empty one; a row without an id fails E nowhere and makes none fail it.
    Repeated rows count each (they have one id, so neither fails E by the other); of repeated labels a 1 holds.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), mask_of(list(text_failures(text).values())).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(*[F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")])
    alike = ["digest", "part", "mask", "quality", "toxic"]
    by_id = rows.join(marks, "id", "left").fillna(0, ["quality", "toxic"]).groupBy("id", *alike).agg(F.count("*").alias("n"))
    named = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    copies = by_id.groupBy(*alike).agg(F.sum("n").alias("n"), F.sum(named["n"]).alias("named"), F.min(named).alias("least"))
    copies = copies.withColumn("first", F.min("least.id").over(Window.partitionBy("digest")))
    later = F.coalesce(F.col("named") - F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0), F.lit(0))
    either = F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - later).alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << 4)).alias("mask"), later.alias("n")))
    split = copies.select("part", "quality", "toxic", F.explode(either).alias("x")).select("part", "quality", "toxic", "x.*")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def corner_values(counts: DataFrame, measures: list[str], filters: int) -> DataFrame:
    """One row a part: for each measure its total, the coefficients of its removal polynomial and the values at all corners.

    The documents of mask m are removed unless x is 0 throughout m: m adds n * (1 - product of (1 - x_i), i in m). Its
    term of a set T, a part of m and not empty, is (-1) ** (len(T) + 1) * n. Arrays are indexed by sets as bit masks.
    """
    sets = 1 << filters
    subset = F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.lit(sets - 1)), lambda t: F.when(t.bitwiseAND(F.col("mask")) == t, t)), lambda t: t.isNotNull()))
    sign = F.when(F.bit_count("term") % 2 == 1, 1).otherwise(-1)
    terms = counts.where("mask > 0").select("part", subset.alias("term"), *measures).groupBy("part", "term").agg(*[F.sum(sign * F.col(m)).alias(m) for m in measures])
    whole = counts.groupBy("part").agg(*[F.sum(m).alias(f"{m}_all") for m in measures])
    poly = terms.groupBy("part").agg(F.collect_list(F.struct("term", *measures)).alias("terms"))  # fewer than 2 ** filters
    out = whole.join(poly, "part", "left").withColumn("terms", F.coalesce("terms", F.array().cast(poly.schema["terms"].dataType)))
    at = lambda m: F.transform(F.sequence(F.lit(0), F.lit(sets - 1)), lambda s: F.aggregate(F.filter("terms", lambda x: x["term"].bitwiseAND(s) == x["term"]), F.lit(0).cast("long"), lambda v, x: v + x[m]))
    return out.select("*", *[at(m).alias(f"{m}_at") for m in measures])


def shapley_sums(terms: str, measure: str, filters: int) -> Column:
    """Array by filter: its Shapley share times the number of orders (filters!), whole numbers.

    The derivative by x_i of a term c * product(T), i in T, is c * t ** (len(T) - 1) on the diagonal, and its integral
    c / len(T). Fractions are kept over one denominator, filters!, which is also the scale: c * (filters! / len(T)) is exact.
    """
    scale = factorial(filters)
    share = lambda i: F.aggregate(F.filter(terms, lambda x: x["term"].bitwiseAND(F.lit(1 << i)) > 0), F.lit(0).cast("long"), lambda v, x: v + x[measure] * (F.lit(scale) / F.bit_count(x["term"])).cast("long"))
    return F.array(*[share(i) for i in range(filters)])


def filter_audit(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, order and step.

    counts(part, mask, n, good, toxic): documents, and those of two kinds, by failure mask; bit k is names[k]'s. A part
    without any failure has its rows, zeros but for kept; without counts there are no rows. The work after the counts
    depends on parts and filters alone.
    """
    k, full = len(names), (1 << len(names)) - 1
    parts = corner_values(counts, ["n", "good", "toxic"], k).withColumn("shares", shapley_sums("terms", "n", k))
    steps = [F.struct(F.lit("".join(p)).alias("filter_order"), F.lit(j + 1).alias("step"), F.lit(sum(1 << names.index(c) for c in p[:j])).alias("before"), F.lit(names.index(p[j])).alias("f")) for p in permutations(names) for j in range(k)]
    rows = parts.select("*", F.explode(F.array(*steps)).alias("s")).select("*", "s.*")
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(k)]), F.col("f") + 1)
    at = lambda m, s: F.get(F.col(f"{m}_at"), s)
    after = F.col("before") + bit
    lost = lambda m: at(m, after) - at(m, F.col("before"))
    out = {
        "kept": F.col("n_all") - at("n", after),
        "removed": lost("n"),
        "redundant": at("n", bit) - lost("n"),
        "unique_fails": at("n", F.lit(full)) - at("n", F.lit(full) - bit),
        "good_lost": lost("good"),
        "toxic_lost": lost("toxic"),
        "shapley": F.get("shares", F.col("f")),
    }
    return rows.select("part", "filter_order", F.col("step").cast("int"), *[v.cast("long").alias(c) for c, v in out.items()])


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """filter_audit of the filters A to E over whole documents, one part a source; see text_masks for nulls, copies and repeats.

    Very long texts are one row like any other; other columns are not read; an empty table gives no rows, empty labels zeros.
    """
    return filter_audit(text_masks(docs, labels))


ORACLE_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
    f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
                 || (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END)
                 || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN first < w.doc_id THEN 'E' ELSE '' END) AS fails
          FROM w LEFT JOIN l USING (doc_id)),
    m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
    c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM c a, c b, c c, c d, c e
          WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
    r AS (SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS hit, fails = f AS alone,
                 length(translate(fails, before, '')) < length(fails) AS gone FROM m, s),
    q AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept,
                 sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant,
                 sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost,
                 sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY 1, 2, 3, 4)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
           CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM q"""
