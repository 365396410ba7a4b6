"""Deterministic splits: class-balanced, nested in K, disjoint, the same on every run and partitioning.

Rows are ranked by a hash of (seed, id), ids breaking ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.model import GraphSet
from knotwork.operators.kg import numbered


def draw(seed: int | Column, *ids: str) -> list[Column]:
    """The order of a seed: 31 bits of MD5 (any engine can check them), then the ids."""
    key = F.concat_ws("|", seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), *[F.col(i).cast("string") for i in ids])
    return [F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), *[F.col(i) for i in ids]]


def first_by(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows with ord from 0: a top-n of every task and then of all, no global sort."""
    return rows.orderBy(*order).limit(n).withColumn("ord", F.row_number().over(Window.orderBy(*order)) - 1)


def shots_per_class(classes: int, most: int = 5, total: int = 60) -> int:
    return max(2, min(most, total // classes))


def few_shot(items: DataFrame, seeds: list[int], spc: int, queries: int = 40, id_column: str = "graph_id") -> DataFrame:
    """seed, id, label, role ("shot", "query"), ord: spc shots a class, and the first of the rest as queries."""
    seeded = items.select(F.col(id_column).alias("id"), "label").withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    rank = F.row_number().over(Window.partitionBy("seed", "label").orderBy(*draw(F.col("seed"), "id")))
    shots = seeded.withColumn("r", rank).filter(F.col("r") <= spc).drop("r").withColumn("role", F.lit("shot"))
    rest = seeded.join(shots.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("role", F.lit("query"))
    # Each role has a limit of its own, so a task ranks no more than the limit of what another sends.
    order = F.row_number().over(Window.partitionBy("seed").orderBy(*draw(F.col("seed") + 1_000_003, "id")))
    out = shots.withColumn("ord", order - 1).unionByName(rest.withColumn("ord", order).filter(F.col("ord") <= queries).withColumn("ord", F.col("ord") - 1))
    return out.select("seed", "id", "label", "role", "ord")


def node_split(nodes: DataFrame, seeds: list[int], k_max: int, queries: int, classes: int) -> DataFrame:
    """seed, node_id, label, role, k: k_max shots a class (k is the least K that has the shot), queries // classes queries a class."""
    seeded = nodes.select("node_id", "label").withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    ranked = seeded.withColumn("k", F.row_number().over(Window.partitionBy("seed", "label").orderBy(*draw(F.col("seed"), "node_id"))))
    per = max(1, queries // classes)
    out = ranked.filter(F.col("k") <= k_max + per).withColumn("role", F.when(F.col("k") <= k_max, F.lit("shot")).otherwise(F.lit("query")))
    total = F.row_number().over(Window.partitionBy("seed", "role").orderBy("k", "label"))
    out = out.withColumn("n", total).filter((F.col("role") == "shot") | (F.col("n") <= queries))
    return out.select("seed", "node_id", "label", "role", F.when(F.col("role") == "shot", F.col("k")).alias("k"))


def positive_pairs(gs: GraphSet, seed: int, n: int) -> DataFrame:
    """graph_id, u, v, ord: n edges of every graph."""
    e = gs.edges.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v"))
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy(*draw(seed, "u", "v")))
    return e.withColumn("ord", rank - 1).filter(F.col("ord") < n)


def negative_pairs(gs: GraphSet, seed: int, n: int, reach: int = 8) -> DataFrame:
    """graph_id, u, v, ord: n pairs of nodes with edges that are not linked.

    Nodes are put in the order of `reach` hashes, and pairs at equal places of two
    orders are candidates: linear in the nodes, where all pairs would be quadratic.
    Graphs of few nodes may give fewer than n; take a larger reach.
    """
    nodes = gs.degrees.filter(F.col("deg") > 0).select("graph_id", "node_id")
    pairs = None
    for i in range(reach):
        a = nodes.withColumn("at", F.row_number().over(Window.partitionBy("graph_id").orderBy(*draw(seed * 1009 + 2 * i, "node_id"))))
        b = nodes.withColumn("at", F.row_number().over(Window.partitionBy("graph_id").orderBy(*draw(seed * 1009 + 2 * i + 1, "node_id"))))
        met = a.withColumnRenamed("node_id", "x").join(b.withColumnRenamed("node_id", "y"), ["graph_id", "at"]).filter(F.col("x") != F.col("y"))
        met = met.select("graph_id", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
        pairs = met if pairs is None else pairs.unionByName(met)
    free = pairs.distinct().join(gs.edges.select("graph_id", F.col("src").alias("u"), F.col("dst").alias("v")), ["graph_id", "u", "v"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy(*draw(seed, "u", "v")))
    return free.withColumn("ord", rank - 1).filter(F.col("ord") < n)


def pair_split(gs: GraphSet, seed: int, k_max: int, queries: int) -> DataFrame:
    """graph_id, u, v, linked, role, k: k_max shots and queries // 2 queries of linked and of unlinked pairs."""
    half = queries // 2
    both = positive_pairs(gs, seed, k_max + half).withColumn("linked", F.lit(True)).unionByName(negative_pairs(gs, seed, k_max + half).withColumn("linked", F.lit(False)))
    return both.select("graph_id", "u", "v", "linked", F.when(F.col("ord") < k_max, F.lit("shot")).otherwise(F.lit("query")).alias("role"), F.when(F.col("ord") < k_max, F.col("ord") + 1).alias("k"))


def triple_split(triples: DataFrame, seed: int, k_max: int, queries: int) -> DataFrame:
    """h, r, t, role, ord: test triples of distinct undirected pairs as queries, then shots of other pairs.

    Of a pair's triples the first by draw stands for it.
    """
    pair = {"a": F.least("h", "t"), "b": F.greatest("h", "t")}
    rows = triples.select("h", "r", "t", "split").withColumns(pair)
    of_pair = Window.partitionBy("a", "b").orderBy(*draw(seed, "h", "r", "t"))
    test = rows.filter(F.col("split") == "test").dropDuplicates(["h", "r", "t"]).withColumn("p", F.row_number().over(of_pair)).filter("p = 1")
    query = first_by(test, queries, draw(seed, "h", "r", "t"))
    others = rows.dropDuplicates(["h", "r", "t"]).join(query.select("a", "b"), ["a", "b"], "left_anti")
    shot = first_by(others, k_max, draw(seed, "h", "r", "t"))
    pick = lambda d, role: d.select("h", "r", "t", F.lit(role).alias("role"), "ord")
    return pick(query, "query").unionByName(pick(shot, "shot"))


def regression_split(items: DataFrame, seed: int, k_max: int, queries: int, train: int = 400, id_column: str = "graph_id") -> DataFrame:
    """id, role, ord: the first k_max are shots, the next are queries; "train" is up to `train` that are no queries."""
    ranked = first_by(items.select(F.col(id_column).alias("id")), max(k_max, train) + queries, draw(seed, "id"))
    first = ranked.filter(F.col("ord") < k_max + queries).withColumn("role", F.when(F.col("ord") < k_max, F.lit("shot")).otherwise(F.lit("query")))
    pool = ranked.filter((F.col("ord") < k_max) | (F.col("ord") >= k_max + queries))
    pool = pool.filter(F.col("ord") < train + F.when(F.col("ord") >= k_max, F.lit(queries)).otherwise(F.lit(0))).withColumn("role", F.lit("train"))
    return first.unionByName(pool).select("id", "role", "ord")


def validation_slice(items: DataFrame, seed: int, share: float = 0.25, id_column: str = "graph_id") -> DataFrame:
    """items with validation: max(1, round(share * class size)) of every class."""
    whole = Window.partitionBy("label")
    rank = F.row_number().over(whole.orderBy(*draw(seed, id_column)))
    return items.withColumn("validation", rank <= F.greatest(F.lit(1), F.bround(F.lit(share) * F.count(F.lit(1)).over(whole)).cast("int")))


def known_mask(nodes: DataFrame, seed: int, share: float = 0.5) -> DataFrame:
    """graph_id, node_id, known: a share of every graph's nodes, rounded down."""
    whole = Window.partitionBy("graph_id")
    rank = F.row_number().over(whole.orderBy(*draw(seed, "node_id")))
    return nodes.select("graph_id", "node_id", (rank <= F.floor(F.lit(share) * F.count(F.lit(1)).over(whole))).alias("known"))


def query_order(queries: DataFrame, seed: int = 12345, id_column: str = "qid", by: str | None = None) -> DataFrame:
    """queries with ord: one fixed shuffle (within `by`)."""
    if by is None:
        return numbered(queries, *draw(seed, id_column), name="ord").withColumn("ord", F.col("ord").cast("int"))
    return queries.withColumn("ord", F.row_number().over(Window.partitionBy(by).orderBy(*draw(seed, id_column))) - 1)


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with side; empty if the splits agree."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))
