"""Connected components of an edge table, without the driver seeing an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import durable


def _stars(edges: DataFrame) -> bool:
    """Whether every edge (a < b, no edge twice) runs from a star's smallest node: b has that edge only."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("upper")).unionByName(edges.select(F.col("b").alias("node"), F.lit(1).alias("upper")))
    by = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("upper").alias("upper"))
    return by.filter((F.col("upper") > 0) & (F.col("n") > 1)).agg(F.count(F.lit(1))).first()[0] == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of every node in edges (a, b).

    Rounds of large-star and small-star steps: neighbours above a node, and then those
    below it, are linked to the smallest node around it. The rounds are logarithmic in
    a component's size in practice. Group minima combine before the shuffle. Edges that
    are stars already take no round.
    """
    edges = durable(edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("low").alias("a"), "b")
        large = large.filter(F.col("a") != F.col("b")).distinct()
        # Every edge now runs from a smaller node a to b; b joins its own neighbours below to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        down = large.join(low, "b")
        small = down.select(F.col("low").alias("a"), "b").unionByName(down.select(F.col("low").alias("a"), F.col("a").alias("b")))
        edges = durable(small.filter(F.col("a") != F.col("b")).distinct())
    members = edges.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
    roots = members.select(F.col("component").alias("node"), "component").distinct()
    return durable(members.unionByName(roots))
