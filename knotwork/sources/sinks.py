"""Sinks of prompts, manifests and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_graphs(gs, path: str) -> None:
    gs.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    gs.edges.write.mode("overwrite").parquet(f"{path}/edges")


def write_prompts(prompts: DataFrame, path: str) -> None:
    """One folder a run with the prompt as text."""
    prompts.select("run", F.col("prompt").alias("value")).repartition("run").write.mode("overwrite").partitionBy("run").text(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)


def write_table(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)
