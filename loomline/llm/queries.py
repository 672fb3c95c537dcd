"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, mixing
from .alignment import alignment_report, load_tokenizers
from .ann import nearest_neighbours
from .bpe import bpe_digests, load_spec
from .common import remainder, shared_dir, table, written
from .jaccard import jaccard_components
from .langid import fit_model, predict_language
from .lm import lm_scores
from .passages import passage_classes
from .simhash import simhash_components
from .syncmers import edit_fingerprints
from .toxicity import fit_model as fit_toxicity
from .toxicity import score_toxicity
from .warc import capture_histories, read_warc, write_warc


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of all whole documents, as digests."""
    return bpe_digests(table(spark, sf_dir, "documents"), load_spec(spark, vocabulary()))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents repeated by Poisson counts to shares by the square root of their source's size, shuffled globally."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all whole documents; learned from rows whose crc32 remainder by 7 is not 2."""
    return lm_scores(table(spark, sf_dir, "documents"), remainder(7) != 2)


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents share, and the classes of documents they make."""
    return passage_classes(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest embeddings of every embedding whose vec_id is divisible by 50."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document; learned from rows whose crc32 remainder by 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = fit_model(docs, remainder(3) != 1)
    out = predict_language(docs.select("doc_id", (remainder(3) == 1).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 4-word shingles, links at 4 or fewer differing bits."""
    return simhash_components(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole document; learned from labels whose crc32 remainder by 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    out = score_toxicity(docs.select("doc_id", (remainder(5) == 0).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, written and read back, in the global order of their captures."""
    path = shared_dir(spark)
    write_warc(table(spark, sf_dir, "pages"), path)
    return capture_histories(written(read_warc(spark, path))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-syncmer fingerprints of all whole documents and of their edited texts."""
    return edit_fingerprints(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all whole documents, in all orders, by source."""
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all whole documents whose sets of 4-word shingles have a Jaccard index of 0.85 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens over all whole documents."""
    import public_tokenizers as p

    spec = load_tokenizers(spark, p.path("byte_bpe_50k.tiktoken"), p.PATTERN, p.path("piece_bpe_32k.model"), p.path("byte_bpe_50k.json"))
    return alignment_report(table(spark, sf_dir, "documents"), spec)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_lm": op3_lm,
    "op4_passages": op4_passages,
    "op5_ann": op5_ann,
    "op6_langid": op6_langid,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_warc": op9_warc,
    "op10_syncmers": op10_syncmers,
    "op11_filter_audit": op11_filter_audit,
    "op12_jaccard": op12_jaccard,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing.oracle_sql(),
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        q AS (SELECT page_id, strlen(payload) AS n, sha1(payload) AS d,
                     CASE WHEN strlen(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS first FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first IS NULL OR first = page_id THEN NULL ELSE first END AS refers_to
        FROM q""",
}
