"""A corpus pipeline of five training-data operators over the documents table.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next stage's docs. All but the last return the columns of docs, whatever
their names, and add none. Every stage takes nulls in any column, empty and very long
texts, repeated rows and empty tables; what becomes of them is said with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knotwork.llm import decontaminate, mixing, near_dedup, quality, shard_tree
from knotwork.llm.common import durable, table


#: Near duplicates of the pipeline: pairs of this similarity in a hundred or more, on sets of five-word runs.
NEAR_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of docs.

    A null or empty text scores the share of good labels; equal texts share their fate.
    """
    space = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, space)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id.

    Rows without doc_id or words stay, and all rows of a doc_id that stays.
    """
    return near_dedup.keep_one(docs, NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; a null or empty text contains none."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source, a text without words is taken once, and equal rows share one decision.
    """
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, text_crc32, law, shard, slot and grown_shard; a column of docs with such a name gets an underscore.

    Rows without doc_id share a shard; equal rows get slots of their own.
    """
    return shard_tree.shard_documents(docs, extra=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicate removal", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: Learned, hashed and random decisions: SQL cannot express the rows. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs)
    return docs
