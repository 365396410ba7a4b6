"""The registered queries of the training-data operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from knotwork.llm import bitsliced, decontaminate, line_dedup, mixing, near_dedup, quality, secrets, shard_tree, surrogates, url_filter
from knotwork.llm.common import table

#: The key of the surrogates in the registered query; a real one comes from a secret store.
SURROGATE_KEY = b"knotwork surrogates"


def op1_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(url_filter.dated_captures(pages), url_filter.derived_entries(pages))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.pseudonymise(documents, SURROGATE_KEY)


def op3_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_hamming_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link_documents(table(spark, sf_dir, "documents"))


def op5_char_cnn_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.shard_documents(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents"))


def op9_bitsliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.search_every(table(spark, sf_dir, "embeddings"))


def op10_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_temporal_url_filter, op2_surrogates, op3_neighbour_quality, op4_hamming_near_dedup, op5_char_cnn_secrets,
        op6_containment_search, op7_hash_tree_shards, op8_line_dedup, op9_bitsliced_top_k, op10_pivotal_mix,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_temporal_url_filter": url_filter.ORACLE,
        "op4_hamming_near_dedup": near_dedup.ORACLE,
        "op6_containment_search": decontaminate.ORACLE,
        "op7_hash_tree_shards": shard_tree.ORACLE,
        "op8_line_dedup": line_dedup.ORACLE,
        "op9_bitsliced_top_k": bitsliced.ORACLE,
    }
