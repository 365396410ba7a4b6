"""All facts of a collection of graphs as one table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.durable import durable
from knotwork.model import GraphSet
from knotwork.operators import kernels, packed
from knotwork.operators.attributes import attribute_facts
from knotwork.plans import structure as S
from knotwork.registry import FEATURE_VERSION, SCALAR_GROUPS, feature_names

#: Groups that need the dense kernel; the others are joins and aggregates.
_KERNEL_GROUPS = set("ADEFGHIJK")
#: What a group takes of the kernel beside components and distances.
_PARTS = {"E": {"communities"}, "F": {"cores", "spectrum"}, "G": {"rings"}, "H": {"betweenness", "closeness", "eigenvector"}}


def structure(gs: GraphSet, groups: str = SCALAR_GROUPS, kernel: DataFrame | None = None, parts: frozenset | None = None) -> DataFrame:
    """graph_id and the scalar facts of the groups as columns; only what they need enters the plan.

    `parts` are the kernel's facts to work out, by default those of the groups; a fact
    without its part is null.
    """
    wanted = set(groups)
    parts = frozenset().union(*(_PARTS.get(g, ()) for g in wanted)) if parts is None else parts
    if gs.groups is not None:
        return packed_structure(gs, groups, parts)
    if len(wanted - set("A")) > 1:
        gs = gs.stored()
    out = S.degree_moments(gs)
    if wanted & _KERNEL_GROUPS:
        k = kernel if kernel is not None else kernels.kernel_facts(gs, parts)
        out = out.join(k.drop("nodes"), "graph_id", "left")
        out = out.withColumn("n_cycles", S.cyclomatic(F.col("n_nodes"), F.col("n_edges"), F.col("n_components")))
    if "B" in wanted:
        out = out.join(S.degree_gini(gs), "graph_id", "left")
    if wanted & set("CJ"):
        out = out.join(S.clustering(gs), "graph_id", "left")
    if "C" in wanted:
        out = out.join(S.four_cycles(gs), "graph_id", "left")
    if "E" in wanted:
        out = out.join(S.degree_assortativity(gs), "graph_id", "left")
    if "J" in wanted:
        out = out.withColumns(S.null_models())
    names = feature_names(groups)
    return out.select("graph_id", *names, *(["ring_sizes"] if "G" in wanted else []))


def packed_structure(gs: GraphSet, groups: str, parts: frozenset, attrs: tuple[str, ...] = (), nodes: bool = False) -> DataFrame:
    """structure() of packed graphs in one pass, with the facts of the attributes as __a0, __a1, ... and those of the nodes as __nodes."""
    caps, names = gs.caps, feature_names(groups)
    deep = bool(set(groups) & _KERNEL_GROUPS)
    about = [f"__a{i}" for i in range(len(attrs))]
    extra = about + ["__nodes"] * nodes

    def rows(g: packed.Opened) -> list[dict]:
        out = packed.sums(g, caps)
        if deep:
            dense = kernels.graph_facts(g.graph_id, g.nodes, g.array, caps, parts)
            each = dense.pop("nodes")
            of = {x["node_id"]: x for x in each}
            out |= dense
            if nodes:
                out["__nodes"] = packed.node_section(g, each, caps)
            for name, attr in zip(about, attrs, strict=True):
                out[name] = packed.attribute_facts(g, attr, [of[v]["betweenness"] for v in g.nodes], [of[v]["community"] for v in g.nodes])
        return [out]

    schema = packed.SUMS + ", " + kernels.KERNEL_SCHEMA.removeprefix("graph_id long, ").partition(", nodes array")[0] + "".join(f", {x} {packed.ATTRIBUTE}" for x in about)
    schema += f", __nodes {packed.SECTION}" if nodes else ""
    none = F.lit(None).cast("double")
    out = packed.each(GraphSet(gs.vertices, gs.edges, caps, groups=gs.groups), rows, schema, structure)
    out = out.withColumns({c: none for c in ("degree_std", "degree_skewness", "degree_kurtosis")} | {"sum_degree": F.col("s1"), "sx": F.col("s2"), "sxx": F.col("s3")})
    out = S.finished_moments(out)
    out = out.withColumns({
        "n_cycles": S.cyclomatic(F.col("n_nodes"), F.col("n_edges"), F.col("n_components")), "degree_gini": S.gini(F.col("n_nodes"), F.col("sum_degree"), F.col("ranks")),
        "transitivity": S.transitivity(F.col("t"), F.col("p")), "n_triangles": (F.col("t") / 3).cast("long"), "degree_assortativity": S.pearson(*map(F.col, ("sum_degree", "sx", "sxx", "sxy"))),
    })
    out = out.withColumns(S.null_models()).select("graph_id", *names, *(["ring_sizes"] if "G" in groups else []), *extra)
    if gs.beyond is None:
        return out
    if extra:
        large = facts(gs.beyond, attrs, nodes=nodes)
        section = [F.col("nodes").alias("__nodes")] if nodes else []
        large = large.select("graph_id", "structure.*", "ring_sizes", *[F.try_element_at("attributes", F.lit(a)).alias(x) for a, x in zip(attrs, about, strict=True)], *section)
    else:
        large = structure(gs.beyond, groups, parts=parts)
    return out.unionByName(large.select(*[F.col(f.name).cast(f.dataType) for f in out.schema]))


def facts(gs: GraphSet, node_attrs: Iterable[str] = (), nodes: bool = True, kernel: DataFrame | None = None, rings: bool = True) -> DataFrame:
    """graph_id, feature_version, structure, ring_sizes, attributes, nodes (null if not asked for).

    attributes is a map from the attribute's name, in the order asked for. nodes holds
    key nodes, and one entry per node for graphs of at most Caps.per_node nodes. The
    graphs and the dense facts are written once, as many facts read them; packed graphs
    are read once, and give no ring sizes without `rings`.
    """
    if isinstance(node_attrs, str):
        raise TypeError("node_attrs is a list of attribute names, not a string")
    node_attrs = list(node_attrs)
    if gs.groups is not None and kernel is None:
        parts = kernels.PARTS if rings else kernels.PARTS - {"rings"}
        out = packed_structure(gs, SCALAR_GROUPS, parts, tuple(node_attrs), nodes)
        section = [F.col("__nodes").alias("nodes")] if nodes else []
        return with_attributes(out.select("graph_id", F.lit(FEATURE_VERSION).alias("feature_version"), F.struct(*feature_names()).alias("structure"), "ring_sizes", *[f"__a{i}" for i in range(len(node_attrs))], *section), node_attrs)
    gs = gs.stored()
    kernel = durable(kernel if kernel is not None else kernels.kernel_facts(gs))
    names = feature_names()
    out = structure(gs, kernel=kernel).select("graph_id", F.lit(FEATURE_VERSION).alias("feature_version"), F.struct(*names).alias("structure"), "ring_sizes")
    per_node = kernels.node_facts(kernel)
    if node_attrs:
        for i, attr in enumerate(node_attrs):
            part = attribute_facts(gs, attr, per_node)
            out = out.join(part.select("graph_id", F.col("facts").alias(f"__a{i}")), "graph_id", "left")
        out = with_attributes(out, node_attrs)
    if nodes:
        out = out.join(node_section(gs, per_node), "graph_id", "left")
    return out


def with_attributes(out: DataFrame, node_attrs: list[str]) -> DataFrame:
    """out with attributes, a map, instead of the columns __a0, __a1, ..."""
    if not node_attrs:
        return out
    entries = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(f"__a{i}").alias("facts")) for i, a in enumerate(node_attrs)])
    attributes = F.map_from_entries(F.filter(entries, lambda x: x["facts"].isNotNull()))
    return out.withColumn("attributes", attributes).drop(*[f"__a{i}" for i in range(len(node_attrs))])


def node_section(gs: GraphSet, per_node: DataFrame, k: int = 5) -> DataFrame:
    """graph_id, nodes: struct of top lists, min_degree_node, n_isolates, per_node."""
    rows = per_node.join(gs.degrees.select("graph_id", "node_id", "deg"), ["graph_id", "node_id"])
    tops = S.degree_extremes(gs)
    for by, name in (("deg", "top_degree"), ("betweenness", "top_betweenness"), ("eigenvector", "top_eigenvector")):
        ranked = S.top_nodes(rows, by, k).groupBy("graph_id")
        entry = F.struct("rank", "node_id", F.col(by).cast("double").alias("value"))
        tops = tops.join(ranked.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["node_id"].alias("node_id"), x["value"].alias("value"))).alias(name)), "graph_id", "left")
    small = rows.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), F.max("betweenness").alias("most_b"), F.max("eigenvector").alias("most_e"))
    kept = rows.join(small.filter(F.col("n") <= gs.caps.per_node).select("graph_id"), "graph_id", "left_semi")
    kept = kept.join(S.neighbor_lists(gs), ["graph_id", "node_id"], "left")
    entry = F.struct(
        "node_ord", "node_id", F.col("deg").alias("degree"), "rounded.betweenness", "rounded.eigenvector", "rounded.closeness", "community", F.coalesce("neighbors", F.array().cast("array<string>")).alias("neighbors"),
    )
    detail = kept.groupBy("graph_id").agg(F.array_sort(F.collect_list(entry)).alias("per_node"))
    tops = tops.join(small.select("graph_id", "most_b", "most_e"), "graph_id", "left").join(detail, "graph_id", "left")
    return tops.select("graph_id", F.struct([c for c in tops.columns if c != "graph_id"]).alias("nodes"))


def facts_json(table: DataFrame) -> DataFrame:
    """graph_id, json: the facts of a graph as one document."""
    return table.select("graph_id", F.to_json(F.struct([c for c in table.columns if c != "graph_id"])).alias("json"))
