"""How a node attribute relates to structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.model import GraphSet
from knotwork.plans.structure import nan


def values(gs: GraphSet, attr: str) -> DataFrame:
    """graph_id, node_id, node_ord, val of the nodes that have the attribute."""
    return gs.vertices.select("graph_id", "node_id", "node_ord", F.try_element_at("attrs", F.lit(attr)).alias("val")).filter(F.col("val").isNotNull())


def composition(gs: GraphSet, attr: str) -> DataFrame:
    """graph_id, val, count, share among the nodes that have the attribute."""
    c = values(gs, attr).groupBy("graph_id", "val").agg(F.count(F.lit(1)).alias("count"))
    return c.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("graph_id")))


def labelled_edges(gs: GraphSet, attr: str) -> DataFrame:
    """edges with va and vb, the values at their ends (null where missing)."""
    v = values(gs, attr)
    a = v.select("graph_id", F.col("node_id").alias("src"), F.col("val").alias("va"))
    b = v.select("graph_id", F.col("node_id").alias("dst"), F.col("val").alias("vb"))
    return gs.edges.join(a, ["graph_id", "src"], "left").join(b, ["graph_id", "dst"], "left")


def edge_types(gs: GraphSet, attr: str) -> DataFrame:
    """graph_id, pair ("a-b", sorted), count, share over the edges with both values."""
    e = labelled_edges(gs, attr).filter(F.col("va").isNotNull() & F.col("vb").isNotNull())
    pair = F.concat(F.least("va", "vb"), F.lit("-"), F.greatest("va", "vb"))
    c = e.groupBy("graph_id", pair.alias("pair")).agg(F.count(F.lit(1)).alias("count"))
    return c.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("graph_id")))


def cross_edges(gs: GraphSet, attr: str) -> DataFrame:
    """graph_id, cross_edges, within_edges. A missing value differs from any other, not from a missing one."""
    differ = (~F.col("va").eqNullSafe(F.col("vb"))).cast("int")
    e = labelled_edges(gs, attr).groupBy("graph_id").agg(F.sum(differ).alias("c"), F.count(F.lit(1)).alias("m"))
    out = gs.vertices.select("graph_id").distinct().join(e, "graph_id", "left")
    return out.select("graph_id", F.coalesce("c", F.lit(0)).alias("cross_edges"), F.coalesce(F.col("m") - F.col("c"), F.lit(0)).alias("within_edges"))


def cross_edge_list(gs: GraphSet, attr: str) -> DataFrame:
    """graph_id, edges: the cross edges in edge order."""
    e = labelled_edges(gs, attr).filter(~F.col("va").eqNullSafe(F.col("vb")))
    rows = F.array_sort(F.collect_list(F.struct("edge_ord", "src", "dst")))
    return e.groupBy("graph_id").agg(F.transform(rows, lambda x: F.struct(x["src"].alias("src"), x["dst"].alias("dst"))).alias("edges"))


def assortativity(gs: GraphSet, attr: str) -> DataFrame:
    """graph_id, attr_assortativity over the symmetric mixing matrix; a missing value is a category of its own.

    NaN for a single group or without edges. From whole numbers: with E ends, T ends
    that meet their own kind and S the sum of squared ends by group, it is
    (T * E - S) / (E * E - S).
    """
    e = labelled_edges(gs, attr).select("graph_id", F.struct("va").alias("a"), F.struct(F.col("vb").alias("va")).alias("b"))
    same = e.groupBy("graph_id").agg((2 * F.count(F.lit(1))).alias("ends"), (2 * F.sum((F.col("a") == F.col("b")).cast("int"))).alias("own"))
    ends = e.select("graph_id", F.explode(F.array("a", "b")).alias("g")).groupBy("graph_id", "g").agg(F.count(F.lit(1)).alias("c"))
    squares = ends.groupBy("graph_id").agg(F.sum(F.col("c") * F.col("c")).alias("s"))
    d = same.join(squares, "graph_id")
    big = lambda c: F.col(c).cast("double")
    top, low = big("own") * big("ends") - big("s"), big("ends") * big("ends") - big("s")
    r = d.select("graph_id", F.when(low > 0, top / low).otherwise(nan()).alias("r"))
    out = gs.vertices.select("graph_id").distinct().join(r, "graph_id", "left")
    return out.select("graph_id", F.coalesce("r", nan()).alias("attr_assortativity"))


def purity(gs: GraphSet, attr: str, communities: DataFrame) -> DataFrame:
    """graph_id, community_purity: labelled nodes that have their community's commonest value; null if none is labelled."""
    c = values(gs, attr).join(communities.select("graph_id", "node_id", "community"), ["graph_id", "node_id"])
    c = c.groupBy("graph_id", "community", "val").agg(F.count(F.lit(1)).alias("c"))
    c = c.groupBy("graph_id", "community").agg(F.max("c").alias("most"), F.sum("c").alias("all"))
    return c.groupBy("graph_id").agg((F.sum("most") / F.sum("all")).alias("community_purity"))


def mean_by_group(gs: GraphSet, attr: str, nodes: DataFrame, value: str = "betweenness") -> DataFrame:
    """graph_id, val, mean of a node fact by group; nodes without the attribute take no part."""
    c = values(gs, attr).join(nodes.select("graph_id", "node_id", value), ["graph_id", "node_id"])
    return c.groupBy("graph_id", "val").agg(F.avg(value).alias("mean"))


def attribute_facts(gs: GraphSet, attr: str, nodes: DataFrame) -> DataFrame:
    """graph_id, attr: a struct of all of the above; graphs where no node has the attribute are left out."""
    comp = composition(gs, attr).groupBy("graph_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("val", "share")))).alias("composition"))
    types = edge_types(gs, attr).groupBy("graph_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pair", "share")))).alias("edge_type_composition"))
    means = mean_by_group(gs, attr, nodes).groupBy("graph_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("val", "mean")))).alias("mean_betweenness_by_group"))
    out = comp.join(types, "graph_id", "left").join(assortativity(gs, attr), "graph_id", "left").join(cross_edges(gs, attr), "graph_id", "left")
    out = out.join(cross_edge_list(gs, attr).withColumnRenamed("edges", "cross_edge_list"), "graph_id", "left").join(purity(gs, attr, nodes), "graph_id", "left").join(means, "graph_id", "left")
    none = F.array().cast("array<struct<src:string,dst:string>>")
    fields = [
        F.map_keys("composition").alias("groups"), "composition",
        F.coalesce("edge_type_composition", F.create_map().cast("map<string,double>")).alias("edge_type_composition"),
        F.col("attr_assortativity").alias("assortativity"), "within_edges", "cross_edges", F.coalesce("cross_edge_list", none).alias("cross_edge_list"), "community_purity", "mean_betweenness_by_group",
    ]
    return out.select("graph_id", F.lit(attr).alias("attr"), F.struct(*fields).alias("facts"))
