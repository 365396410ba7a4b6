"""Collections of graphs: scans, filters, profiles and alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.model import GraphSet, graph_set
from knotwork.plans.structure import size

POOL_CAP = 4000

# Symbols of the elements that the molecule sets hold.
SYMBOLS = {1: "H", 5: "B", 6: "C", 7: "N", 8: "O", 9: "F", 14: "Si", 15: "P", 16: "S", 17: "Cl", 35: "Br", 53: "I"}


def read_graphs(spark: SparkSession, path: str) -> GraphSet:
    """A collection stored as path/vertices and path/edges."""
    return graph_set(spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/vertices"))


def usable(gs: GraphSet, cap: int | None = POOL_CAP) -> DataFrame:
    """graph_id of the graphs of three nodes and an edge at least, the first `cap` of the collection by id."""
    ids = gs.vertices.select("graph_id").distinct()
    if cap is not None:
        ids = ids.orderBy("graph_id").limit(cap)
    return size(gs.only(ids)).filter("n_nodes >= 3 and n_edges >= 1").select("graph_id")


def profile(gs: GraphSet, graphs: DataFrame, name: str, domain: str, first: int = 100) -> DataFrame:
    """name, domain, n, classes, avgN, avgE (of the first graphs by id), chance (share of the commonest label)."""
    labels = graphs.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    whole = labels.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("classes"), F.round(F.max("c") / F.sum("c"), 3).alias("chance"))
    head = graphs.select("graph_id").orderBy("graph_id").limit(first)
    sizes = size(gs.only(head)).agg(F.round(F.avg("n_nodes"), 1).alias("avgN"), F.round(F.avg("n_edges"), 1).alias("avgE"))
    has = F.max((F.size("attrs") > 0).cast("int")) == 1
    kinds = gs.vertices.select(F.explode(F.map_values("attrs")).alias("v")).agg(F.count_distinct("v").alias("ncat"))
    one = whole.join(sizes).join(gs.vertices.agg(has.alias("has_x"))).join(kinds)  # single rows
    return one.select(F.lit(name).alias("name"), F.lit(domain).alias("domain"), "n", "classes", "avgN", "avgE", "has_x", "ncat", "chance")


def merge_profiles(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and those of new whose name it lacks."""
    return old.unionByName(new.join(old.select("name"), "name", "left_anti"))


def categories(nodes: DataFrame) -> DataFrame:
    """nodes (graph_id, node_id, x array<double>) with category, where a graph's rows are all one-hot; null otherwise."""
    one_hot = (F.abs(F.aggregate("x", F.lit(0.0), lambda s, v: s + v) - 1) < 1e-8) & F.forall("x", lambda v: (v == 0) | (v == 1))
    clean = nodes.groupBy("graph_id").agg(F.every(one_hot).alias("clean"))
    category = F.when(F.col("clean"), F.array_position("x", 1.0) - 1)
    return nodes.join(clean, "graph_id").withColumn("category", category).drop("clean")


def symbol(number: Column) -> Column:
    """The element of an atomic number, or Z and the number."""
    table = F.create_map(*[F.lit(x) for z, s in SYMBOLS.items() for x in (z, s)])
    return F.coalesce(F.try_element_at(table, number.cast("int")), F.concat(F.lit("Z"), number.cast("int").cast("string")))


def molecules(edges: DataFrame, atoms: DataFrame) -> GraphSet:
    """Graphs with attribute type from atoms (graph_id, node_id, number)."""
    return graph_set(edges, atoms.withColumn("attrs", F.create_map(F.lit("type"), symbol(F.col("number")))))


def element_lines(atoms: DataFrame) -> DataFrame:
    """graph_id, text: "Atoms (9 total): Cx6, Ox2, Nx1", the commonest first and then the first seen."""
    c = atoms.groupBy("graph_id", symbol(F.col("number")).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("node_ord").alias("o"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "o", F.concat("s", F.lit("x"), F.col("n").cast("string")).alias("x"))))
    return c.groupBy("graph_id").agg(F.concat(F.lit("Atoms ("), F.sum("n").cast("string"), F.lit(" total): "), F.array_join(F.transform(rows, lambda r: r["x"]), ", ")).alias("text"))


def embeddings(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """graph_id, features for every kept graph; a missing or non-finite vector is an error when it is read."""
    joined = kept.select("graph_id").join(rows, "graph_id", "left")
    fine = F.col("features").isNotNull() & ~F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return joined.withColumn("features", F.when(fine, F.col("features")).otherwise(F.raise_error(F.concat(F.lit("no finite embedding of graph "), F.col("graph_id").cast("string"))).cast("array<double>")))


def aligned_by_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id, unique: rows (id, x) whose binarised vectors are equal, one to one in id order where several are."""
    key = F.md5(F.concat_ws(",", F.transform("x", lambda v: F.when(v > 0, F.lit("1")).otherwise(F.lit("0")))))
    w = Window.partitionBy("key").orderBy("id")
    number = lambda d: d.select("id", key.alias("key")).withColumns({"n": F.row_number().over(w), "many": F.count(F.lit(1)).over(Window.partitionBy("key"))})
    a = number(left).select(F.col("id").alias("left_id"), "key", "n")
    b = number(right).select(F.col("id").alias("right_id"), "key", "n", "many")
    return a.join(b, ["key", "n"]).select("left_id", "right_id", (F.col("many") == 1).alias("unique"))


def aligned_by_class(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """nodes (id, label) with text: the id-th (modulo) text of the node's class from texts (id, label, text)."""
    pool = texts.withColumns({"n": F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1, "size": F.count(F.lit(1)).over(Window.partitionBy("label"))})
    sizes = pool.select("label", "size").distinct()
    asked = nodes.join(sizes, "label", "left").withColumn("n", F.pmod("id", "size").cast("int"))
    out = asked.join(pool.select("label", "n", "text"), ["label", "n"], "left")
    return out.select("id", "label", F.coalesce("text", F.concat(F.lit("(no text; class "), F.col("label").cast("string"), F.lit(")"))).alias("text"))
