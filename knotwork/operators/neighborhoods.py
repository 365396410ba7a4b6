"""Neighbourhoods as new graphs: one graph per target, so all facts apply unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.durable import durable
from knotwork.model import GraphSet, graph_set


def within(gs: GraphSet, seeds: DataFrame, hops: int) -> DataFrame:
    """seed_id, graph_id, node_id, dist: nodes within `hops` of any seed node of a seed_id (seed_id, graph_id, node_id)."""
    sym = gs.sym
    out = seeds.select("seed_id", "graph_id", "node_id").distinct().withColumn("dist", F.lit(0))
    for hop in range(1, hops + 1):
        step = out.filter(F.col("dist") == hop - 1).join(sym.withColumnRenamed("src", "node_id"), ["graph_id", "node_id"])
        out = out.unionByName(step.select("seed_id", "graph_id", F.col("dst").alias("node_id"), F.lit(hop).alias("dist")))
        out = out.groupBy("seed_id", "graph_id", "node_id").agg(F.min("dist").alias("dist"))
    return out


def nearest(gs: GraphSet, members: DataFrame, cap: int) -> DataFrame:
    """members with local, their place from 0 by (dist, seed place, node order); at most cap of each seed_id."""
    order = gs.vertices.select("graph_id", "node_id", "node_ord")
    rank = Window.partitionBy("seed_id").orderBy("dist", F.col("place").asc_nulls_last(), "node_ord", "node_id")
    return members.join(order, ["graph_id", "node_id"]).withColumn("local", F.row_number().over(rank) - 1).filter(F.col("local") < cap)


def _induced(gs: GraphSet, members: DataFrame, hide: DataFrame | None = None) -> GraphSet:
    """A GraphSet whose graph_id is seed_id and whose nodes are the places; `hide` (seed_id, a, b) are places not to link."""
    a = members.select("seed_id", "graph_id", F.col("node_id").alias("src"), F.col("local").alias("i"))
    b = members.select("seed_id", "graph_id", F.col("node_id").alias("dst"), F.col("local").alias("j"))
    e = gs.edges.select("graph_id", "src", "dst").join(a, ["graph_id", "src"]).join(b, ["seed_id", "graph_id", "dst"])
    e = e.select("seed_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    if hide is not None:
        e = e.join(hide, ["seed_id", "i", "j"], "left_anti")
    edges = e.select(F.col("seed_id").alias("graph_id"), F.col("i").cast("string").alias("src"), F.col("j").cast("string").alias("dst"))
    vertices = members.select(F.col("seed_id").alias("graph_id"), F.col("local").cast("string").alias("node_id"), F.col("local").cast("int").alias("node_ord"))
    return graph_set(edges, vertices, gs.caps)


def ego_graphs(gs: GraphSet, targets: DataFrame, hops: int = 2, cap: int = 25) -> tuple[GraphSet, DataFrame]:
    """The neighbourhoods of targets (seed_id, graph_id, node_id), the target as node 0; and their members."""
    near = within(gs, targets, hops).withColumn("place", F.when(F.col("dist") == 0, F.lit(0)))
    members = nearest(gs, near, cap)
    return _induced(gs, members), members


def joint_graphs(gs: GraphSet, pairs: DataFrame, hops: int = 2, cap: int = 30) -> tuple[GraphSet, DataFrame]:
    """The joint neighbourhoods of pairs (seed_id, graph_id, u, v), u and v as nodes 0 and 1 and never linked."""
    ends = pairs.select("seed_id", "graph_id", F.posexplode(F.array("u", "v")).alias("place", "node_id"))
    near = within(gs, ends, hops).join(ends.select("seed_id", "node_id", "place"), ["seed_id", "node_id"], "left")
    members = nearest(gs, near, cap)
    return _induced(gs, members, pairs.select("seed_id", F.lit(0).alias("i"), F.lit(1).alias("j"))), members


def observed(gs: GraphSet, removed: DataFrame) -> GraphSet:
    """The graph without the pairs of `removed` (graph_id, u, v), in either direction."""
    gone = removed.select("graph_id", F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"))
    return GraphSet(gs.vertices, gs.edges.join(gone, ["graph_id", "src", "dst"], "left_anti"), gs.caps)


def observed_triples(triples: DataFrame, removed: DataFrame) -> DataFrame:
    """triples (h, r, t) without those of a removed pair (h, t), whatever relation and direction."""
    gone = removed.select(F.least("h", "t").alias("__a"), F.greatest("h", "t").alias("__b")).distinct()
    keyed = triples.withColumns({"__a": F.least("h", "t"), "__b": F.greatest("h", "t")})
    return keyed.join(gone, ["__a", "__b"], "left_anti").drop("__a", "__b")


def skeleton(triples: DataFrame) -> GraphSet:
    """The untyped graph of triples, as graph 0."""
    return graph_set(triples.select(F.lit(0).cast("long").alias("graph_id"), F.col("h").alias("src"), F.col("t").alias("dst")))


def incident(triples: DataFrame) -> DataFrame:
    """ent, h, r, t: every triple at each of its ends."""
    return triples.select(F.explode(F.array_distinct(F.array("h", "t"))).alias("ent"), "h", "r", "t")


#: Triples at an entity beyond the cap that are kept for those of a query's own ends, which do not count.
SPARE = 8


def typed_context(triples: DataFrame, queries: DataFrame, cap: int = 24, head_only: bool = False, spare: int = SPARE) -> DataFrame:
    """qid, lines: "(h) -[r]-> (t)" of the triples at the head and then the tail of queries (qid, h, t), a row a qid.

    Triples between the query's own ends are left out; at most cap, in the order (h, r, t).
    An entity keeps its first cap + spare triples in one row, so a hub of many queries
    and triples does not bring all of them together; the tail is looked up only where
    the head leaves room. A query with more than `spare` triples between its own ends
    among these reads all triples at its ends.
    """
    most = cap + spare
    rank = F.dense_rank().over(Window.partitionBy("ent").orderBy("h", "r", "t"))
    first = incident(triples).withColumn("n", rank).filter(F.col("n") <= most)
    lists = durable(first.groupBy("ent").agg(F.array_sort(F.collect_set(F.struct("h", "r", "t"))).alias("all")))
    asked = queries.select("qid", F.col("h").alias("qh"), F.col("t").alias("qt"))

    def at(rows: DataFrame, end: str) -> DataFrame:
        """rows with found, the triples at an end but for those of the query's own ends, and whether there may be more."""
        met = rows.join(lists.select(F.col("ent").alias(end), "all"), end, "left")
        own = lambda x: ((x["h"] == F.col("qh")) & (x["t"] == F.col("qt"))) | ((x["h"] == F.col("qt")) & (x["t"] == F.col("qh")))
        found = F.filter(F.coalesce("all", F.array().cast(lists.schema["all"].dataType)), lambda x: ~own(x))
        more = (F.coalesce(F.size("all"), F.lit(0)) >= most) & (F.size("found") < cap)
        return met.withColumn("found", found).withColumn("more", more).drop("all")

    head = durable(at(asked, "qh").withColumn("found", F.slice("found", 1, cap)))
    full = head.filter((F.size("found") >= cap) | F.col("more") | F.lit(head_only))
    rest = head.filter(~((F.size("found") >= cap) | F.col("more") | F.lit(head_only))).select("qid", "qh", "qt", F.col("found").alias("before"))
    tail = at(rest, "qt").withColumn("found", F.slice(F.concat("before", F.array_except("found", "before")), 1, cap)).drop("before")
    # What the tail shares with the head is not new, so a tail is only whole if the query has its lines.
    tail = tail.withColumn("more", F.col("more") & (F.size("found") < cap))
    out = durable(full.select("qid", "found", "more").unionByName(tail.select("qid", "found", "more")))
    line = lambda x: F.concat(F.lit("("), x["h"], F.lit(") -["), x["r"], F.lit("]-> ("), x["t"], F.lit(")"))
    lines = out.filter(~F.col("more")).select("qid", F.transform("found", line).alias("lines"))
    open_ = out.filter("more").select("qid")
    return lines if open_.isEmpty() else lines.unionByName(whole_context(triples, queries.join(open_, "qid", "left_semi"), cap, head_only))


def whole_context(triples: DataFrame, queries: DataFrame, cap: int, head_only: bool) -> DataFrame:
    """typed_context from all triples at the ends of the queries."""
    ends = F.array(F.struct(F.lit(0).alias("side"), F.col("h").alias("ent")), *([] if head_only else [F.struct(F.lit(1).alias("side"), F.col("t").alias("ent"))]))
    asked = queries.select("qid", F.col("h").alias("qh"), F.col("t").alias("qt"), F.explode(ends).alias("e")).select("qid", "qh", "qt", "e.side", "e.ent")
    own = ((F.col("h") == F.col("qh")) & (F.col("t") == F.col("qt"))) | ((F.col("h") == F.col("qt")) & (F.col("t") == F.col("qh")))
    rows = asked.join(incident(triples), "ent").filter(~own).groupBy("qid", "h", "r", "t").agg(F.min("side").alias("side"))
    rank = Window.partitionBy("qid").orderBy("side", "h", "r", "t")
    rows = rows.withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= cap)
    line = F.concat(F.lit("("), F.col("h"), F.lit(") -["), F.col("r"), F.lit("]-> ("), F.col("t"), F.lit(")"))
    lists = rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    return queries.select("qid").distinct().join(lists, "qid", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))


def permuted(gs: GraphSet, seed: int) -> GraphSet:
    """The graphs with node labels dealt anew by a hash of (seed, node): the control of structure without labels."""
    rank = Window.partitionBy("graph_id").orderBy(F.xxhash64(F.lit(seed), "graph_id", "node_id"), "node_id")
    new = gs.vertices.withColumn("new", F.row_number().over(rank) - 1)
    names = gs.vertices.select("graph_id", F.col("node_ord").alias("new"), F.col("node_id").alias("to"))
    mapped = new.join(names, ["graph_id", "new"]).select("graph_id", "node_id", "to")
    a = mapped.select("graph_id", F.col("node_id").alias("src"), F.col("to").alias("s2"))
    b = mapped.select("graph_id", F.col("node_id").alias("dst"), F.col("to").alias("d2"))
    edges = gs.edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).select("graph_id", F.col("s2").alias("src"), F.col("d2").alias("dst"))
    return graph_set(edges, gs.vertices, gs.caps)


def edge_text(gs: GraphSet) -> DataFrame:
    """graph_id, text: "edges: (a,b), ..." by node order."""
    o = gs.vertices.select("graph_id", "node_id", "node_ord")
    a = o.select("graph_id", F.col("node_id").alias("src"), F.col("node_ord").alias("i"))
    b = o.select("graph_id", F.col("node_id").alias("dst"), F.col("node_ord").alias("j"))
    e = gs.edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
    first = F.col("i") <= F.col("j")
    row = F.struct(
        F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"),
        F.concat(F.lit("("), F.when(first, F.col("src")).otherwise(F.col("dst")), F.lit(","), F.when(first, F.col("dst")).otherwise(F.col("src")), F.lit(")")).alias("x"),
    )
    lists = e.groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["x"]), ", ").alias("x"))
    return gs.vertices.select("graph_id").distinct().join(lists, "graph_id", "left").select("graph_id", F.concat(F.lit("edges: "), F.coalesce("x", F.lit(""))).alias("text"))


def anonymous(members: DataFrame, extra: DataFrame | None = None, prefix: str = "A", width: int = 2) -> DataFrame:
    """seed_id, node_id, token by place; nodes of `extra` (seed_id, node_id) that are no members get the next tokens."""
    rows = members.select("seed_id", "node_id", F.col("local").cast("long").alias("at"))
    if extra is not None:
        new = extra.select("seed_id", "node_id").distinct().join(rows, ["seed_id", "node_id"], "left_anti")
        sizes = rows.groupBy("seed_id").agg((F.max("at") + 1).alias("n"))
        rank = F.row_number().over(Window.partitionBy("seed_id").orderBy("node_id")) - 1
        rows = rows.unionByName(new.join(sizes, "seed_id", "left").select("seed_id", "node_id", (F.coalesce("n", F.lit(0)) + rank).alias("at")))
    return rows.select("seed_id", "node_id", token(F.col("at"), prefix, width).alias("token"))


def token(number: Column, prefix: str, width: int) -> Column:
    """prefix and the number, with zeros up to width digits; longer numbers stay whole."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0")))


def top_features(nodes: DataFrame, w: int = 8) -> DataFrame:
    """nodes (…, x array<double>) with features: "w3,w7" of the w largest non-zero entries, by value and then place."""
    entries = F.filter(F.transform("x", lambda v, i: F.struct((-v).alias("v"), i.alias("i"))), lambda e: e["v"] != 0)
    named = F.transform(F.slice(F.array_sort(entries), 1, w), lambda e: F.concat(F.lit("w"), e["i"].cast("string")))
    return nodes.withColumn("features", F.when(F.size(named) > 0, F.array_join(named, ",")).otherwise(F.lit("(none)")))


def shortened(text: Column, most: int = 320) -> Column:
    """The text on one line, cut at the last space before `most` characters."""
    flat = F.replace(F.trim(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" "))
    cut = F.regexp_replace(F.substring(flat, 1, most), r" [^ ]*$", "")
    return F.when(F.length(flat) > most, F.concat(cut, F.lit(" ..."))).otherwise(flat)
