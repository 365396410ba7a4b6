"""Graphs pasted as text, one text a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.model import GraphSet, graph_set


def _chunks(text: str) -> Column:
    return F.posexplode(F.split(F.col(text), "[,\n;]", -1)).alias("pos", "chunk")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _ends(chunk: Column, pos: Column) -> Column:
    """struct(src, dst, edge_ord) of a part like "a-b" (the first dash) or of two words; null for others."""
    chunk = _strip(chunk)
    words = F.split(chunk, r"\s+", -1)
    pair = F.when(F.contains(chunk, F.lit("-")), F.split(chunk, "-", 2)).when(F.size(words) == 2, words)
    src, dst = _strip(pair[0]), _strip(pair[1])
    return F.when((src != "") & (dst != ""), F.struct(src.alias("src"), dst.alias("dst"), pos.alias("edge_ord")))


def parse_edges(texts: DataFrame, text: str = "edges_text", needed: bool = False) -> DataFrame:
    """graph_id, src, dst, edge_ord from texts like "a-b, b-c; c d": a first dash, or two words; other parts are dropped.

    If edges are needed, a text without any is an error. It is raised in the text's own
    row, as a join with no edges on one side may never be run.
    """
    ends = F.filter(F.transform(F.split(F.col(text), "[,\n;]", -1), _ends), lambda x: x.isNotNull())
    if needed:
        ends = F.when(F.size(ends) > 0, ends).otherwise(F.raise_error(F.lit("no valid edges: write them like '0-1, 1-2, 2-0'")))
    return texts.select("graph_id", F.explode(ends).alias("e")).select("graph_id", "e.src", "e.dst", "e.edge_ord")


def parse_attributes(texts: DataFrame, text: str = "attrs_text") -> DataFrame:
    """graph_id, node_id, val from texts like "a:x, b:y": the first colon splits, the last of repeats holds."""
    rows = texts.select("graph_id", _chunks(text)).filter(F.contains(F.col("chunk"), F.lit(":")))
    parts = F.split("chunk", ":", 2)
    rows = rows.select("graph_id", "pos", _strip(parts[0]).alias("node_id"), _strip(parts[1]).alias("val")).filter((F.col("node_id") != "") & (F.col("val") != ""))
    return rows.groupBy("graph_id", "node_id").agg(F.max_by("val", "pos").alias("val"))


def graphs_from_text(texts: DataFrame, name: str = "group", missing: str = "?") -> GraphSet:
    """texts (graph_id, edges_text, attrs_text) as graphs; attributes only for nodes of edges, `missing` where none is given.

    A graph whose text has no edge is an error, as soon as its rows are read.
    """
    edges = parse_edges(texts, needed=True)
    nodes = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    given = parse_attributes(texts).withColumn("some", F.lit(1))
    any_given = given.groupBy("graph_id").agg(F.lit(True).alias("any"))
    rows = nodes.join(given, ["graph_id", "node_id"], "left").join(any_given, "graph_id", "left")
    value = F.when(F.col("any"), F.create_map(F.lit(name), F.coalesce("val", F.lit(missing)))).otherwise(F.create_map().cast("map<string,string>"))
    return graph_set(edges, rows.select("graph_id", "node_id", value.alias("attrs")))
