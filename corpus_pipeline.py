"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all rows that the one before kept; run() writes each stage's result to the shared folder and reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripwatch.llm import language_id, near_dedup, packing, secret_scan, suffix_dedup
from tripwatch.llm.common import materialise


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the filter knows; those without letters, or mostly unknown n-grams, go."""
    return language_id.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least id."""
    return near_dedup.deduplicate(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that occur elsewhere."""
    return suffix_dedup.deduplicate(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced."""
    return secret_scan.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in the packed sequences."""
    return packing.digest(docs)


STAGES = [("language_id", languages), ("near_dedup", near_duplicates), ("suffix_dedup", repeats), ("secret_scan", secrets), ("packing", sequences)]

#: Fitting a language filter, a forest and a tokenizer is beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
