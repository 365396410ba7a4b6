"""Operators on large graphs as loops over tables: a round is joins and aggregates, and is written before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.durable import durable
from knotwork.model import GraphSet


def components(gs: GraphSet) -> DataFrame:
    """graph_id, node_id, component: the smallest node_id reachable.

    Rounds of large-star and small-star steps over the edges, about logarithmic in the
    size of a component; isolated nodes are their own.
    """
    edges = durable(gs.edges.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select("graph_id", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("graph_id", "a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        up = both.filter(F.col("b") > F.col("a")).join(low, ["graph_id", "a"]).select("graph_id", F.col("low").alias("a"), "b").filter("a != b").distinct()
        low = up.groupBy("graph_id", "b").agg(F.min("a").alias("low"))
        down = up.join(low, ["graph_id", "b"])
        edges = durable(down.select("graph_id", F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a != b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("graph_id", "a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = edges.groupBy("graph_id", F.col("b").alias("node_id")).agg(F.min("a").alias("component"))
    out = gs.vertices.select("graph_id", "node_id").join(found, ["graph_id", "node_id"], "left")
    return out.withColumn("component", F.coalesce("component", "node_id"))


def distances(gs: GraphSet, sources: DataFrame | None = None, most_hops: int | None = None) -> DataFrame:
    """graph_id, s, t, d, paths: shortest distances and their numbers from the sources (all nodes if None).

    A breadth-first search of all sources at once: the frontier joins the edges, sums
    path counts, and leaves out what was reached before. Quadratic in a graph for all
    sources, so give sources (pivots) for a large graph.
    """
    start = gs.vertices if sources is None else sources
    front = start.select("graph_id", F.col("node_id").alias("s"), F.col("node_id").alias("t")).distinct()
    front = durable(front.withColumns({"d": F.lit(0), "paths": F.lit(1.0)}))
    sym = durable(gs.sym)
    reached, hop = front, 0
    while most_hops is None or hop < most_hops:
        step = front.join(sym.select("graph_id", F.col("src").alias("t"), "dst"), ["graph_id", "t"])
        step = step.groupBy("graph_id", "s", F.col("dst").alias("t")).agg(F.sum("paths").alias("paths"))
        hop += 1
        front = durable(step.join(reached, ["graph_id", "s", "t"], "left_anti").select("graph_id", "s", "t", F.lit(hop).alias("d"), "paths"))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
        if hop % 4 == 0:
            reached = durable(reached)
    return reached


def pair_distances(gs: GraphSet, pairs: DataFrame) -> DataFrame:
    """graph_id, u, v, d of the pairs (graph_id, u, v) that have a path.

    Both ends of a pair are searched in turn, a hop each, and a pair leaves the search
    when the sides meet, so about half the distance is walked from either end.
    """
    start = pairs.select("graph_id", "u", "v").distinct()
    sym = durable(gs.sym.withColumnRenamed("src", "at"))
    key = ["graph_id", "u", "v"]
    seen = [durable(start.withColumn("at", F.col(c))) for c in ("u", "v")]
    front, found, hop = list(seen), start.filter(F.col("u") == F.col("v")).withColumn("d", F.lit(0)), 0
    while True:
        side = hop % 2
        hop += 1
        step = front[side].join(sym, ["graph_id", "at"]).select(*key, F.col("dst").alias("at")).distinct()
        front[side] = durable(step.join(seen[side], [*key, "at"], "left_anti"))
        # A side that cannot go on has reached all it can without meeting the other.
        alive = front[side].select(*key).distinct()
        met = durable(front[side].join(seen[1 - side], [*key, "at"], "left_semi").select(*key).distinct().join(found, key, "left_anti").withColumn("d", F.lit(hop)))
        found = found.unionByName(met)
        go = durable(alive.join(met, key, "left_anti"))
        if go.isEmpty():
            return found
        seen[side] = durable(seen[side].unionByName(front[side]).join(go, key, "left_semi"))
        front = [f.join(go, key, "left_semi") for f in front]


def pivots(gs: GraphSet, k: int, seed: int = 0) -> DataFrame:
    """graph_id, node_id: k nodes of every graph by a hash of (seed, id)."""
    from pyspark.sql import Window

    order = Window.partitionBy("graph_id").orderBy(F.xxhash64(F.lit(seed), "node_id"), "node_id")
    return gs.vertices.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("graph_id", "node_id")


def betweenness(gs: GraphSet, dist: DataFrame) -> DataFrame:
    """graph_id, node_id, betweenness: normalised, from distances of all sources or of a sample, scaled up.

    Dependencies flow back one level at a time from the farthest, as in Brandes.
    """
    n = gs.vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    sym = gs.sym
    k = dist.filter("d = 0").groupBy("graph_id").agg(F.count(F.lit(1)).alias("k"))
    last = dist.agg(F.max("d")).first()[0] or 0
    depend = None
    for level in range(last, 0, -1):
        far = dist.filter(F.col("d") == level)
        if depend is not None:
            far = far.join(depend.filter(F.col("d") == level).select("graph_id", "s", "t", "dep"), ["graph_id", "s", "t"], "left")
        else:
            far = far.withColumn("dep", F.lit(0.0))
        share = far.withColumn("share", (1 + F.coalesce("dep", F.lit(0.0))) / F.col("paths")).select("graph_id", "s", F.col("t").alias("src"), "share")
        near = dist.filter(F.col("d") == level - 1).select("graph_id", "s", F.col("t").alias("dst"), "paths")
        got = share.join(sym, ["graph_id", "src"]).join(near, ["graph_id", "s", "dst"])
        got = got.groupBy("graph_id", "s", F.col("dst").alias("t")).agg(F.sum(F.col("share") * F.col("paths")).alias("dep")).withColumn("d", F.lit(level - 1))
        got = durable(got)
        depend = got if depend is None else depend.unionByName(got)
    out = gs.vertices.select("graph_id", "node_id").join(n, "graph_id").join(k, "graph_id", "left")
    if depend is None:
        return out.select("graph_id", "node_id", F.lit(0.0).alias("betweenness"))
    sums = depend.filter(F.col("s") != F.col("t")).groupBy("graph_id", F.col("t").alias("node_id")).agg(F.sum("dep").alias("dep"))
    value = F.when(F.col("n") > 2, F.coalesce("dep", F.lit(0.0)) / ((F.col("n") - 1) * (F.col("n") - 2)) * F.col("n") / F.col("k")).otherwise(F.lit(0.0))
    return out.join(sums, ["graph_id", "node_id"], "left").select("graph_id", "node_id", value.alias("betweenness"))


def closeness(gs: GraphSet, dist: DataFrame) -> DataFrame:
    """graph_id, node_id, closeness from distances of all sources."""
    n = gs.vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    c = dist.filter("d > 0").groupBy("graph_id", F.col("s").alias("node_id")).agg(F.count(F.lit(1)).alias("r"), F.sum("d").alias("total"))
    out = gs.vertices.select("graph_id", "node_id").join(n, "graph_id").join(c, ["graph_id", "node_id"], "left")
    return out.select("graph_id", "node_id", F.coalesce(F.col("r") * F.col("r") / (F.col("total") * (F.col("n") - 1)), F.lit(0.0)).alias("closeness"))


def path_facts(gs: GraphSet, dist: DataFrame) -> DataFrame:
    """graph_id, avg_path_length, diameter, radius of the largest component (the first of equal ones); 0 for single nodes."""
    order = gs.vertices.select("graph_id", F.col("node_id").alias("t"), "node_ord")
    per = dist.join(order, ["graph_id", "t"]).groupBy("graph_id", "s").agg(F.count(F.lit(1)).alias("size"), F.min("node_ord").alias("comp"), F.max("d").alias("ecc"), F.sum("d").alias("total"))
    largest = per.groupBy("graph_id").agg(F.max(F.struct("size", (-F.col("comp")).alias("c"))).alias("best"))
    inner = per.join(largest, "graph_id").filter((F.col("size") == F.col("best.size")) & (F.col("comp") == -F.col("best.c")))
    apl = F.when(F.max("size") > 1, F.sum("total") / (F.max("size") * (F.max("size") - 1))).otherwise(F.lit(0.0))
    return inner.groupBy("graph_id").agg(apl.alias("avg_path_length"), F.max("ecc").alias("diameter"), F.min("ecc").alias("radius"))


def core_numbers(gs: GraphSet) -> DataFrame:
    """graph_id, node_id, core: all graphs are peeled at once, k by k; a graph without nodes left is done."""
    left = durable(gs.degrees.select("graph_id", "node_id"))
    sym = durable(gs.sym)
    out, k = None, 0
    while not left.isEmpty():
        live = left.select("graph_id", F.col("node_id").alias("dst"))
        alive = sym.join(left.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").join(live, ["graph_id", "dst"], "left_semi")
        deg = alive.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("deg"))
        state = durable(left.join(deg, ["graph_id", "node_id"], "left").withColumn("deg", F.coalesce("deg", F.lit(0))))
        least = state.agg(F.min("deg")).first()[0]
        k = max(k, least)
        gone = state.filter(F.col("deg") <= k).select("graph_id", "node_id", F.lit(k).alias("core"))
        out = gone if out is None else out.unionByName(gone)
        left, sym = durable(state.filter(F.col("deg") > k).select("graph_id", "node_id")), durable(alive)
    return out if out is not None else left.withColumn("core", F.lit(0))


def eigenvector(gs: GraphSet, rounds: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """graph_id, node_id, eigenvector by power iteration on A + I, unit length, non-negative; 0 without edges."""
    n = gs.vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    x = durable(gs.vertices.select("graph_id", "node_id").join(n, "graph_id").select("graph_id", "node_id", (1 / F.sqrt("n")).alias("x")))
    sym = durable(gs.sym)
    for _ in range(rounds):
        pulled = sym.join(x.withColumnRenamed("node_id", "src"), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.sum("x").alias("y"))
        y = x.join(pulled, ["graph_id", "node_id"], "left").withColumn("y", F.col("x") + F.coalesce("y", F.lit(0.0)))
        norm = y.groupBy("graph_id").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
        new = durable(y.join(norm, "graph_id").select("graph_id", "node_id", (F.col("y") / F.col("norm")).alias("x"), F.abs(F.col("y") / F.col("norm") - F.col("x")).alias("move")))
        x = new.drop("move")
        if (new.agg(F.max("move")).first()[0] or 0.0) < tolerance:
            break
    some = gs.edges.select("graph_id").distinct().withColumn("some", F.lit(True))
    return x.join(some, "graph_id", "left").select("graph_id", "node_id", F.when(F.col("some"), F.col("x")).otherwise(F.lit(0.0)).alias("eigenvector"))
