"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordfold.llm import decontaminate, exact_dedup, io, langid, packing, set_join

#: Near duplicates: shingles of five words, similarity of 80 % or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted."""
    return langid.accepted_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.unique_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts the document with the smallest id."""
    return set_join.first_documents(docs, NEAR_WORDS, NEAR_PERCENT, stored=True)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), stored=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences."""
    return packing.packed_documents(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("packing", packed)]

#: SQL can't express language identification or tokenization.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = io.spread(io.documents(spark, sf_dir))
    for name, stage in STAGES:
        docs = io.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
