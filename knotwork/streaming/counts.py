"""Running sizes and degrees of graphs whose edges arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_degrees(edges: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """graph_id, node_id, deg from a stream (graph_id, src, dst, ts); an edge that repeats within the watermark counts once."""
    once = edges.filter(F.col("src") != F.col("dst")).select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "ts")
    once = once.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["graph_id", "src", "dst"])
    return once.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).groupBy("graph_id", "node_id").agg(F.count(F.lit(1)).alias("deg"))


def running_sizes(edges: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """graph_id, n_edges from the same stream."""
    once = edges.filter(F.col("src") != F.col("dst")).select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "ts")
    once = once.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["graph_id", "src", "dst"])
    return once.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"))
