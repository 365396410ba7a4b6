"""Graphs as plain tables: vertices and edges keyed by graph_id."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.durable import durable


#: More nodes than any graph has.
NO_CAP = 1 << 62


@dataclass(frozen=True)
class Caps:
    """Sizes up to which a fact is computed; above, it is null (or sampled, for betweenness). Only ring sizes have a cap unless one is given."""

    squares: int = NO_CAP
    paths: int = NO_CAP
    exact_betweenness: int = NO_CAP
    pivots: int = 100
    per_node: int = NO_CAP
    ring_nodes: int = 400
    ring_edges: int = 1200
    ring_excess: int = 60
    #: Nodes of a graph that one task holds as a dense matrix; larger graphs take the iterative operators.
    dense: int = 2000
    #: Nodes of a graph that one task holds as lists of neighbours, for communities and the spectrum.
    merged: int = NO_CAP


@dataclass(frozen=True)
class GraphSet:
    """vertices (graph_id, node_id, node_ord, attrs), edges (graph_id, src, dst, edge_ord, w).

    Edges are distinct, without self-loops, src before dst as strings.
    """

    vertices: DataFrame
    edges: DataFrame
    caps: Caps = field(default_factory=Caps)
    #: graph_id, node_id, node_ord, deg where they are stored.
    known_degrees: DataFrame | None = None
    #: graph_id, groups: nodes that are linked with each other, as operators.packed opens them, where that is how the graphs came.
    groups: DataFrame | None = None
    #: The graphs that are too large for a row of groups.
    beyond: GraphSet | None = None

    def stored(self) -> GraphSet:
        """The same graphs, written once with their degrees: for several facts, or graphs that cost much to derive."""
        if self.known_degrees is not None:
            return self
        flat = GraphSet(durable(self.vertices), durable(self.edges), self.caps)
        return GraphSet(flat.vertices, flat.edges, self.caps, durable(flat.degrees))

    @property
    def sym(self) -> DataFrame:
        """graph_id, src, dst in both directions."""
        e = self.edges.select("graph_id", "src", "dst")
        return e.unionByName(e.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")))

    @property
    def degrees(self) -> DataFrame:
        """graph_id, node_id, node_ord, deg; isolated nodes have 0."""
        if self.known_degrees is not None:
            return self.known_degrees
        ends = self.edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id"))
        counts = ends.groupBy("graph_id", "node_id").agg(F.count(F.lit(1)).alias("deg"))
        out = self.vertices.select("graph_id", "node_id", "node_ord").join(counts, ["graph_id", "node_id"], "left")
        return out.withColumn("deg", F.coalesce("deg", F.lit(0)))

    def only(self, ids: DataFrame) -> GraphSet:
        """The graphs whose graph_id is in ids: compute facts for used graphs only."""
        keep = ids.select("graph_id").distinct()
        return GraphSet(self.vertices.join(keep, "graph_id", "left_semi"), self.edges.join(keep, "graph_id", "left_semi"), self.caps)


def undirect(edges: DataFrame) -> DataFrame:
    """Undirected simple edges: both directions and repeats become one, self-loops go.

    edge_ord is the first place an edge had (edge_ord of the input, or 0).
    """
    order = F.col("edge_ord") if "edge_ord" in edges.columns else F.lit(0)
    weight = F.col("w") if "w" in edges.columns else F.lit(1.0)
    ends = edges.filter(F.col("src") != F.col("dst")).select(
        "graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), order.cast("int").alias("edge_ord"), weight.cast("double").alias("w")
    )
    return ends.groupBy("graph_id", "src", "dst").agg(F.min("edge_ord").alias("edge_ord"), F.max("w").alias("w"))


def graph_set(edges: DataFrame, vertices: DataFrame | None = None, caps: Caps | None = None) -> GraphSet:
    """A GraphSet from raw edges (graph_id, src, dst, ...) and optional vertices.

    Without vertices the nodes are the ends of edges, self-loops included. Without
    node_ord nodes are in the order of node_id.
    """
    edges = edges.withColumns({"src": F.col("src").cast("string"), "dst": F.col("dst").cast("string")})
    if vertices is None:
        vertices = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    vertices = vertices.withColumn("node_id", F.col("node_id").cast("string"))
    if "node_ord" not in vertices.columns:
        vertices = vertices.withColumn("node_ord", F.row_number().over(Window.partitionBy("graph_id").orderBy("node_id")) - 1)
    if "attrs" not in vertices.columns:
        vertices = vertices.withColumn("attrs", F.create_map().cast("map<string,string>"))
    return GraphSet(vertices.select("graph_id", "node_id", "node_ord", "attrs"), undirect(edges), caps or Caps())
