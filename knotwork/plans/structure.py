"""Structural facts that are relational: joins, aggregates and windows only.

Each function gives one row per graph, from aggregates keyed by graph_id, so that a
left join of facts that nobody selects is pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.model import GraphSet


def nan() -> Column:
    return F.lit("NaN").cast("double")


def size(gs: GraphSet) -> DataFrame:
    """graph_id, n_nodes, n_edges, density; isolated nodes count."""
    n = gs.vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    m = gs.edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"))
    out = n.join(m, "graph_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return out.withColumn("density", density(F.col("n_nodes"), F.col("n_edges")))


def density(n: Column, m: Column) -> Column:
    return F.when((n > 1) & (m > 0), 2.0 * m / (n * (n - 1))).otherwise(F.lit(0.0))


#: Degrees whose fourth power has 63 bits; a sum would pass over a larger one as null.
FOURTH_POWER_FITS = 55_000


def _times(*x: Column) -> Column:
    out = x[0]
    for y in x[1:]:
        out = F.try_multiply(out, y)
    return out


def _plus(*x: Column) -> Column:
    out = x[0]
    for y in x[1:]:
        out = F.try_add(out, y)
    return out


def _shape() -> tuple[Column, Column, Column]:
    """Standard deviation, skewness and excess kurtosis from n_nodes and the power sums s1 to s4.

    Whole numbers up to the last division, so that the order of the rows does not
    matter; null where they pass 38 digits, or a power sum 64 bits. Single powers must fit.
    """
    n, s1, s2, s3, s4 = (F.col(c).cast("decimal(38,0)") for c in ("n_nodes", "s1", "s2", "s3", "s4"))
    k = lambda x: F.lit(x).cast("decimal(38,0)")
    two = _plus(_times(n, s2), _times(k(-1), s1, s1)).cast("double")
    three = _plus(_times(n, n, s3), _times(k(-3), n, s1, s2), _times(k(2), s1, s1, s1)).cast("double")
    four = _plus(_times(n, n, n, s4), _times(k(-4), n, n, s1, s3), _times(k(6), n, s1, s1, s2), _times(k(-3), s1, s1, s1, s1)).cast("double")
    flat = two == 0
    return F.sqrt(two) / F.col("n_nodes"), F.when(flat, 0.0).otherwise(three / (two * F.sqrt(two))), F.when(flat, 0.0).otherwise(four / (two * two) - 3)


def degree_moments(gs: GraphSet) -> DataFrame:
    """graph_id, n_nodes, n_edges, density and the shape of the degree distribution, in one pass over the degrees."""
    d, whole = F.col("deg").cast("double"), F.col("deg").cast("long")
    agg = gs.degrees.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        (F.sum("deg") / 2).cast("long").alias("n_edges"),
        F.avg(d).alias("mean_degree"),
        F.max("deg").alias("max_degree"),
        F.min("deg").alias("min_degree"),
        F.stddev_pop(d).alias("degree_std"),
        F.coalesce(F.skewness(d), F.lit(0.0)).alias("degree_skewness"),
        F.coalesce(F.kurtosis(d), F.lit(0.0)).alias("degree_kurtosis"),
        F.avg(d * d).alias("k2"),
        F.sum(F.when(d > 0, F.log(d / 0.5))).alias("log_sum"),
        F.count_if(F.col("deg") == 0).alias("n_isolates"),
        *[F.try_sum(_times(*[whole] * k)).alias(f"s{k}") for k in (1, 2, 3, 4)],
    )
    return finished_moments(agg)


def finished_moments(agg: DataFrame) -> DataFrame:
    """degree_moments from the sums over the degrees of a graph."""
    # Graphs whose numbers are too large for whole-number arithmetic keep the moments in floating point.
    exact = dict(zip(("degree_std", "degree_skewness", "degree_kurtosis"), _shape(), strict=True))
    fits = F.coalesce(F.col("max_degree"), F.lit(0)) <= FOURTH_POWER_FITS
    agg = agg.withColumns({c: F.coalesce(F.when(fits, e), F.col(c)) for c, e in exact.items()}).drop("s1", "s2", "s3", "s4")
    mean = F.col("mean_degree")
    config = F.when(mean > 0, F.pow(F.col("k2") - mean, F.lit(2.0)) / (F.col("n_nodes") * F.pow(mean, F.lit(3.0)))).otherwise(F.lit(0.0))
    alpha = F.when(F.col("min_degree") > 0, 1 + F.col("n_nodes") / F.col("log_sum")).otherwise(nan())
    return agg.withColumns({
        "density": density(F.col("n_nodes"), F.col("n_edges")),
        "max_over_mean_degree": F.when(mean > 0, F.col("max_degree") / mean).otherwise(F.lit(0.0)),
        "powerlaw_alpha": alpha,
        "config_clustering": config,
    }).drop("log_sum")


def degree_gini(gs: GraphSet) -> DataFrame:
    """graph_id, degree_gini. Over the degree histogram: ties share a run of ranks, so no window is as long as a graph."""
    hist = gs.degrees.groupBy("graph_id", "deg").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("graph_id").orderBy("deg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = hist.withColumn("ranks", F.col("c") * before + F.col("c") * (F.col("c") + 1) / 2)
    agg = ranked.groupBy("graph_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("deg")).alias("s"), F.sum(F.col("ranks") * F.col("deg")).alias("rs"))
    return agg.select("graph_id", gini(F.col("n"), F.col("s"), F.col("rs")).alias("degree_gini"))


def gini(n: Column, s: Column, ranks: Column) -> Column:
    """From the nodes, the sum of the degrees and the sum of degrees times ranks."""
    return F.when(s > 0, 2.0 * ranks / (n * s) - (n + 1) / n).otherwise(F.lit(0.0))


def oriented(gs: GraphSet) -> DataFrame:
    """graph_id, lo, hi: every edge from its end of smaller (degree, id); out-degrees stay below sqrt(2m)."""
    d = gs.degrees.select("graph_id", "node_id", "deg")
    a = d.select("graph_id", F.col("node_id").alias("src"), F.col("deg").alias("ds"))
    b = d.select("graph_id", F.col("node_id").alias("dst"), F.col("deg").alias("dd"))
    e = gs.edges.select("graph_id", "src", "dst").join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
    first = F.struct("ds", "src") < F.struct(F.col("dd"), F.col("dst"))
    return e.select("graph_id", F.when(first, F.col("src")).otherwise(F.col("dst")).alias("lo"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("hi"))


def triangles(gs: GraphSet) -> DataFrame:
    """graph_id, node_id, triangles of every node in one; wedges at the end of smallest degree, closed by an equi-join."""
    e = oriented(gs)
    a, b = e.select("graph_id", "lo", F.col("hi").alias("x")), e.select("graph_id", "lo", F.col("hi").alias("y"))
    wedges = a.join(b, ["graph_id", "lo"]).filter(F.col("x") < F.col("y"))
    closing = gs.edges.select("graph_id", F.col("src").alias("x"), F.col("dst").alias("y"))
    corners = wedges.join(closing, ["graph_id", "x", "y"]).select("graph_id", F.explode(F.array("lo", "x", "y")).alias("node_id"))
    return corners.groupBy("graph_id", "node_id").agg(F.count(F.lit(1)).alias("triangles"))


def local_clustering(gs: GraphSet) -> DataFrame:
    """graph_id, node_id, node_ord, deg, triangles, clustering (0 below degree 2)."""
    d = gs.degrees.join(triangles(gs), ["graph_id", "node_id"], "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    c = F.when(F.col("deg") > 1, 2.0 * F.col("triangles") / (F.col("deg") * (F.col("deg") - 1))).otherwise(F.lit(0.0))
    return d.withColumn("clustering", c)


def clustering(gs: GraphSet) -> DataFrame:
    """graph_id, avg_clustering, transitivity, n_triangles."""
    return clustering_of(clustering_sums(gs))


def clustering_sums(gs: GraphSet) -> DataFrame:
    """graph_id, avg_clustering, t (triangles at nodes), p (pairs of neighbours)."""
    pairs = F.sum(F.col("deg") * (F.col("deg") - 1) / 2)
    return local_clustering(gs).groupBy("graph_id").agg(F.avg("clustering").alias("avg_clustering"), F.sum("triangles").alias("t"), pairs.alias("p"))


def clustering_of(agg: DataFrame) -> DataFrame:
    return agg.select("graph_id", "avg_clustering", transitivity(F.col("t"), F.col("p")).alias("transitivity"), (F.col("t") / 3).cast("long").alias("n_triangles"))


def transitivity(t: Column, pairs: Column) -> Column:
    return F.when(pairs > 0, t / pairs).otherwise(F.lit(0.0))


def four_cycles(gs: GraphSet) -> DataFrame:
    """graph_id, n_squares: each at its corner of largest (degree, id), as pairs of paths to the opposite one; null above the cap.

    An edge meets the neighbours of its end of smaller degree alone, so a hub makes no pairs of its neighbours.
    """
    n = gs.vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    small = n.filter(F.col("n") <= gs.caps.squares).select("graph_id")
    d = gs.degrees.select("graph_id", F.col("node_id").alias("dst"), F.struct("deg", F.col("node_id").alias("id")).alias("top"))
    e = oriented(gs).join(small, "graph_id", "left_semi").select("graph_id", F.col("lo").alias("mid"), F.col("hi").alias("dst")).join(d, ["graph_id", "dst"])
    s = gs.sym.select("graph_id", F.col("src").alias("mid"), "dst").join(d, ["graph_id", "dst"]).select("graph_id", "mid", F.col("top").alias("other"))
    paths = e.select("graph_id", "mid", "top").join(s, ["graph_id", "mid"]).filter(F.col("other") < F.col("top"))
    common = paths.groupBy("graph_id", "top", "other").agg(F.count(F.lit(1)).alias("c"))
    squares = common.groupBy("graph_id").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).cast("long").alias("q"))
    out = n.join(squares, "graph_id", "left")
    return out.select("graph_id", F.when(F.col("n") <= gs.caps.squares, F.coalesce("q", F.lit(0))).alias("n_squares"))


def degree_assortativity(gs: GraphSet) -> DataFrame:
    """graph_id, degree_assortativity: Pearson over both directions of the edges, NaN without variance.

    From power sums, all whole numbers, so a regular graph is seen exactly.
    """
    d = gs.degrees
    sums = d.groupBy("graph_id").agg(F.sum("deg").alias("n"), F.sum(F.col("deg") * F.col("deg")).alias("sx"), F.sum(F.col("deg") * F.col("deg") * F.col("deg")).alias("sxx"))
    a = d.select("graph_id", F.col("node_id").alias("src"), F.col("deg").alias("ds"))
    b = d.select("graph_id", F.col("node_id").alias("dst"), F.col("deg").alias("dd"))
    e = gs.edges.select("graph_id", "src", "dst").join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
    xy = e.groupBy("graph_id").agg((2 * F.sum(F.col("ds") * F.col("dd"))).alias("sxy"))
    out = sums.join(xy, "graph_id", "left")
    return out.select("graph_id", pearson(*map(F.col, ("n", "sx", "sxx", "sxy"))).alias("degree_assortativity"))


def pearson(n: Column, sx: Column, sxx: Column, sxy: Column) -> Column:
    """Of the degrees at both ends of an edge, from sums over both directions; NaN without variance."""
    n, sx, sxx, sxy = (c.cast("double") for c in (n, sx, sxx, sxy))
    var = n * sxx - sx * sx
    return F.when((n > 0) & (var > 0), (n * sxy - sx * sx) / var).otherwise(nan())


def modularity(gs: GraphSet, partition: DataFrame, label: str = "community") -> DataFrame:
    """graph_id, modularity of a partition (graph_id, node_id, label); 0 without edges."""
    p = partition.select("graph_id", "node_id", F.col(label).alias("c"))
    a = p.select("graph_id", F.col("node_id").alias("src"), F.col("c").alias("ca"))
    b = p.select("graph_id", F.col("node_id").alias("dst"), F.col("c").alias("cb"))
    inside = gs.edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).filter(F.col("ca") == F.col("cb"))
    inside = inside.groupBy("graph_id", F.col("ca").alias("c")).agg(F.count(F.lit(1)).alias("l"))
    ends = gs.degrees.join(p, ["graph_id", "node_id"]).groupBy("graph_id", "c").agg(F.sum("deg").alias("d"))
    m = gs.degrees.groupBy("graph_id").agg((F.sum("deg") / 2).alias("m"))
    terms = ends.join(inside, ["graph_id", "c"], "left").join(m, "graph_id")
    share = F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), F.lit(2.0))
    q = terms.groupBy("graph_id").agg(F.sum(F.when(F.col("m") > 0, share)).alias("q"))
    return q.select("graph_id", F.coalesce("q", F.lit(0.0)).alias("modularity"))


def null_models() -> dict[str, Column]:
    """Contrasts with null models from avg_clustering, density, mean_degree, n_nodes, config_clustering, avg_path_length."""
    c, dens, k = F.col("avg_clustering"), F.col("density"), F.col("mean_degree")
    path = F.when(F.col("avg_path_length") > 0, F.col("avg_path_length"))
    random_path = F.when(k > 1, F.log(F.col("n_nodes").cast("double")) / F.log(k))
    lattice = F.when(k > 1, 3 * (k - 2) / (4 * (k - 1)))
    sigma = F.when((dens > 0) & path.isNotNull() & random_path.isNotNull(), F.try_divide(c / dens, F.try_divide(path, random_path)))
    omega = F.when(path.isNotNull() & lattice.isNotNull() & (lattice != 0), random_path / path - F.try_divide(c, lattice))
    return {
        "er_clustering_ratio": F.when(dens > 0, F.try_divide(c, dens)).otherwise(nan()),
        "config_clustering_ratio": F.when(F.col("config_clustering") > 0, F.try_divide(c, F.col("config_clustering"))).otherwise(nan()),
        "smallworld_sigma": F.coalesce(sigma, nan()),
        "smallworld_omega": F.coalesce(omega, nan()),
    }


def cyclomatic(n: Column, m: Column, components: Column) -> Column:
    return F.when(n > 0, m - n + components).otherwise(F.lit(0))


def top_nodes(values: DataFrame, by: str, k: int = 5) -> DataFrame:
    """The k nodes of a graph with the largest value, ties by node_id; with their rank."""
    w = Window.partitionBy("graph_id").orderBy(F.col(by).desc(), "node_id")
    return values.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def degree_extremes(gs: GraphSet) -> DataFrame:
    """graph_id, min_degree_node (first in node order), n_isolates."""
    return gs.degrees.groupBy("graph_id").agg(F.min_by("node_id", F.struct("deg", "node_ord")).alias("min_degree_node"), F.count_if(F.col("deg") == 0).alias("n_isolates"))


def hub_share(gs: GraphSet) -> DataFrame:
    """graph_id, frac_hubs: share of nodes whose degree is over twice the mean."""
    d = gs.degrees
    mean = d.groupBy("graph_id").agg(F.avg("deg").alias("mean"))
    return d.join(mean, "graph_id").groupBy("graph_id").agg(F.avg((F.col("deg") > 2 * F.col("mean")).cast("int")).alias("frac_hubs"))


def neighbor_lists(gs: GraphSet) -> DataFrame:
    """graph_id, node_id, neighbors in node order."""
    order = gs.vertices.select("graph_id", F.col("node_id").alias("dst"), "node_ord")
    lists = gs.sym.join(order, ["graph_id", "dst"]).groupBy("graph_id", F.col("src").alias("node_id"))
    return lists.agg(F.transform(F.array_sort(F.collect_list(F.struct("node_ord", "dst"))), lambda x: x["dst"]).alias("neighbors"))
