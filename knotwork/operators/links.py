"""Features of node pairs and of neighbours' labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.render import filled
from knotwork.model import GraphSet
from knotwork.operators.iterative import pair_distances

LINK_FEATURES = ("common_neighbors", "jaccard", "adamic_adar", "resource_allocation", "preferential_attachment", "shortest_path", "same_community")


def common_neighbours(gs: GraphSet, pairs: DataFrame) -> DataFrame:
    """graph_id, u, v, w, dw: every common neighbour of the pairs, with its degree."""
    sym = gs.sym
    a = sym.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("w"))
    b = sym.select("graph_id", F.col("src").alias("v"), F.col("dst").alias("w"))
    d = gs.degrees.select("graph_id", F.col("node_id").alias("w"), F.col("deg").alias("dw"))
    return pairs.select("graph_id", "u", "v").join(a, ["graph_id", "u"]).join(b, ["graph_id", "v", "w"]).join(d, ["graph_id", "w"])


def link_features(gs: GraphSet, pairs: DataFrame, communities: DataFrame | None = None, paths: bool = True) -> DataFrame:
    """pairs (graph_id, u, v) with the link features; shortest_path is -1 without a path.

    The pair's own edge should be left out of gs. Without communities there is no
    same_community.
    """
    pairs = pairs.select("graph_id", "u", "v").distinct()
    per = common_neighbours(gs, pairs).groupBy("graph_id", "u", "v").agg(
        F.count(F.lit(1)).alias("cn"), F.sum(F.when(F.col("dw") > 1, 1 / F.log(F.col("dw").cast("double")))).alias("aa"), F.sum(1.0 / F.col("dw")).alias("ra")
    )
    d = gs.degrees
    du = d.select("graph_id", F.col("node_id").alias("u"), F.col("deg").alias("du"))
    dv = d.select("graph_id", F.col("node_id").alias("v"), F.col("deg").alias("dv"))
    out = pairs.join(per, ["graph_id", "u", "v"], "left").join(du, ["graph_id", "u"], "left").join(dv, ["graph_id", "v"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    union = zero("du") + zero("dv") - zero("cn")
    out = out.select(
        "graph_id", "u", "v", zero("cn").cast("long").alias("common_neighbors"), F.when(union > 0, zero("cn") / union).otherwise(F.lit(0.0)).alias("jaccard"),
        F.coalesce("aa", F.lit(0.0)).alias("adamic_adar"), F.coalesce("ra", F.lit(0.0)).alias("resource_allocation"), (zero("du") * zero("dv")).cast("long").alias("preferential_attachment"),
    )
    if paths:
        near = pair_distances(gs, pairs).withColumnRenamed("d", "shortest_path")
        out = out.join(near, ["graph_id", "u", "v"], "left").withColumn("shortest_path", F.coalesce("shortest_path", F.lit(-1)))
    if communities is not None:
        a = communities.select("graph_id", F.col("node_id").alias("u"), F.col("community").alias("cu"))
        b = communities.select("graph_id", F.col("node_id").alias("v"), F.col("community").alias("cv"))
        out = out.join(a, ["graph_id", "u"], "left").join(b, ["graph_id", "v"], "left")
        out = out.withColumn("same_community", F.coalesce((F.col("cu") == F.col("cv")).cast("int"), F.lit(0))).drop("cu", "cv")
    return out


def link_lines(features: DataFrame) -> DataFrame:
    """graph_id, u, v, text: the features of a pair in one line."""
    # The line and its parts.
    line = (
        "Link features (computed on the observed graph, excluding this pair): common-neighbors={common_neighbors}, Jaccard={jaccard:.3f}, Adamic-Adar={adamic_adar:.3f}, "
        "resource-allocation={resource_allocation:.3f}, preferential-attachment={preferential_attachment}, shortest-path-length={path}"
    )
    no_path, same = "no path (disconnected in observed graph)", ", same-community="
    hops = F.col("shortest_path")
    values = {c: F.col(c) for c in LINK_FEATURES[:5]} | {"path": F.when(hops < 0, F.lit(no_path)).otherwise(hops.cast("string"))}
    text = filled(line, values)
    if "same_community" in features.columns:
        text = F.concat(text, F.lit(same), F.when(F.col("same_community") == 1, F.lit("yes")).otherwise(F.lit("no")))
    return features.select("graph_id", "u", "v", text.alias("text"))


def neighbour_labels(gs: GraphSet, labels: DataFrame, classes: list[str], known: DataFrame | None = None) -> DataFrame:
    """graph_id, node_id, counts (of each class among known neighbours), vote.

    vote is the first class of the largest count, or where no neighbour is known the
    commonest known label (the first of equal ones).
    """
    seen = labels.select("graph_id", "node_id", "label")
    if known is not None:
        seen = seen.join(known.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi")
    near = gs.sym.join(seen.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"])
    counts = near.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.array(*[F.count_if(F.col("label") == c) for c in classes]).alias("counts"))
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label"))
    common = seen.groupBy("graph_id", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("graph_id").agg(F.max_by("label", F.struct("c", -at)).alias("common"))
    none = F.array(*[F.lit(0).cast("long") for _ in classes])
    out = gs.vertices.select("graph_id", "node_id").join(counts, ["graph_id", "node_id"], "left").withColumn("counts", F.coalesce("counts", none)).join(common, "graph_id", "left")
    first = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("counts", F.array_max("counts")).cast("int"))
    return out.select("graph_id", "node_id", "counts", F.when(F.array_max("counts") > 0, first).otherwise(F.col("common")).alias("vote"))


def type_composition(gs: GraphSet, attr: str, values: list[str]) -> DataFrame:
    """graph_id, composition: the share of each value, in the given order."""
    v = F.try_element_at("attrs", F.lit(attr))
    return gs.vertices.groupBy("graph_id").agg(F.count(v).alias("n"), F.array(*[F.try_divide(F.count_if(v == x), F.count(v)) for x in values]).alias("composition")).drop("n")
