"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_trie, fingerprints, language_id, near_dedup, packing, quality_rules, secret_scan, sentencepiece_codec, substring_dedup, suffix_dedup, toxicity, url_filter, vector_codes


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _over_documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": _over_documents(sentencepiece_codec.digest),
        "op2_suffix_dedup": _over_documents(suffix_dedup.digest),
        "op3_quality_rules": _over_documents(quality_rules.digest),
        "op4_near_dedup": _over_documents(near_dedup.digest),
        "op5_packing": _over_documents(packing.digest),
        "op6_language_id": _over_documents(language_id.digest),
        "op7_secret_scan": _over_documents(secret_scan.digest),
        "op8_toxicity": op8_toxicity,
        "op9_url_filters": op9_url_filters,
        "op10_fingerprints": _over_documents(fingerprints.digest),
        "op11_substring_dedup": _over_documents(substring_dedup.digest),
        "op12_conversation_trie": op12_conversation_trie,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality_rules.oracle_sql(), "op10_fingerprints": fingerprints.oracle_sql(), "op11_substring_dedup": substring_dedup.oracle_sql(), "op12_conversation_trie": conversation_trie.oracle_sql(), "op13_vector_codes": vector_codes.oracle_sql()}
