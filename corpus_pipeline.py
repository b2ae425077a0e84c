"""A training-corpus pipeline: rules, toxicity, near duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each stage's rows to the shared folder and reads them for the next.  All
stages but the last keep the columns of ``documents``.  Nulls, empty texts,
repeated rows, empty tables and further columns are handled as the operators'
own docstrings say; repeated rows of one id leave the third stage once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamella.llm import best_fit, jaccard_join, quality_rules, toxicity
from lamella.llm._store import discard, materialize, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level rules keep."""
    return quality_rules.kept_documents(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents in sequences."""
    return best_fit.packed_documents(docs)


STAGES = [("quality", quality), ("toxicity", clean), ("near_duplicates", distinct), ("packing", pack)]

#: Tokenization and best-fit choice cannot be said in SQL; a test compares all stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote on its way, and its input, go when its table is whole."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = materialize(stage(spark, docs, sf_dir), name)
            keep(docs)
        if before is not None:
            discard(before)
        before = docs
    return docs
