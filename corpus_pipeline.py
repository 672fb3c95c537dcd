"""The corpus pipeline: five stages over documents, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm.bpe import bpe_encode, load_spec
from loomline.llm.common import table, written
from loomline.llm.mixing import mix_sources
from loomline.llm.passages import drop_shared_passages
from loomline.llm.queries import vocabulary
from loomline.llm.simhash import drop_alike
from loomline.llm.toxicity import fit_model, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under one half; the classifier learns from all labels."""
    model = fit_model(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, score_col="__toxicity").where("__toxicity < 0.5").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: sets of five-word shingles alike to 0.8 or more; fingerprints of 512 bits give the candidates."""
    return drop_alike(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has, cut out."""
    return drop_shared_passages(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to shares by the square root of their source's size, in a global random order."""
    return mix_sources(docs).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    return bpe_encode(docs, load_spec(spark, vocabulary()))


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("passages", passages), ("mixing", mixing), ("encoding", encoding)]

#: Fingerprints, learned scores and passages can't be put in SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
