"""A training corpus from raw documents: five operators, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spoolworks.llm.exact import drop_exact_duplicates
from spoolworks.llm.jaccard import keep_first_of_groups
from spoolworks.llm.language import keep_known_language
from spoolworks.llm.mixing import mixed_documents
from spoolworks.llm.pieces import encode_documents
from spoolworks.session import bound_batches, write_through


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one language has at least half of the letters."""
    bound_batches(spark)
    return keep_known_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    bound_batches(spark)
    return keep_first_of_groups(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as sampled piece ids."""
    bound_batches(spark)
    return encode_documents(docs, keep=["doc_id", "lang", "source"])


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("sentencepiece", tokens)]

#: Language spans and sampled segmentations are no SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_through(stage(spark, docs, sf_dir), name)
    return docs
