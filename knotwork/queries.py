"""The registered queries, each with SQL that should give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork import facts as facts_
from knotwork.durable import durable
from knotwork.functions import render, words
from knotwork.model import GraphSet
from knotwork.operators import answers, attributes, iterative, kernels, kg, learners, links, metrics, neighborhoods, packed, prompts, splits
from knotwork.plans import structure as S
from knotwork.registry import feature_column, feature_names
from knotwork.sources import builtin, collections, testdata, text

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The co-purchase collection in SQL: nodes V, edges E, both directions S, degrees D, sizes N.
G1 = """
R AS (SELECT DISTINCT o_custkey AS g, l_orderkey AS o, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
V AS (SELECT DISTINCT g, CAST(p AS VARCHAR) AS v, p FROM R),
E AS (SELECT DISTINCT a.g, least(CAST(a.p AS VARCHAR), CAST(b.p AS VARCHAR)) AS s, greatest(CAST(a.p AS VARCHAR), CAST(b.p AS VARCHAR)) AS t
      FROM R a JOIN R b ON a.g = b.g AND a.o = b.o AND a.p < b.p),
S AS (SELECT g, s, t FROM E UNION ALL SELECT g, t, s FROM E),
D AS (SELECT V.g, V.v, V.p, coalesce(c, 0) AS d FROM V LEFT JOIN (SELECT g, s AS v, count(*) AS c FROM S GROUP BY ALL) x ON V.g = x.g AND V.v = x.v),
N AS (SELECT g, count(*) AS n, CAST(sum(d) / 2 AS BIGINT) AS m, avg(d) AS k FROM D GROUP BY g)"""
#: Distances of all pairs, and components with their size, as more of the same.
DIST = """,
W AS (SELECT g, v AS s, v AS t, 0 AS d FROM V UNION SELECT W.g, W.s, S.t, W.d + 1 FROM W JOIN S ON W.g = S.g AND W.t = S.s WHERE W.d < 14),
dist AS (SELECT g, s, t, min(d) AS d FROM W GROUP BY ALL)"""
LCC = """,
ord AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) AS o FROM V),
ecc AS (SELECT dist.g, dist.s, count(*) AS size, max(d) AS ecc, sum(d) AS total, min(o) AS comp FROM dist JOIN ord ON dist.g = ord.g AND dist.t = ord.v GROUP BY ALL),
big AS (SELECT g, size, comp FROM (SELECT DISTINCT g, size, comp, row_number() OVER (PARTITION BY g ORDER BY size DESC, comp) AS r FROM ecc) WHERE r = 1),
lcc AS (SELECT e.g, max(e.size) AS size, CASE WHEN max(e.size) > 1 THEN sum(total) / (max(e.size) * (max(e.size) - 1)) ELSE 0 END AS apl, max(ecc) AS diameter, min(ecc) AS radius
        FROM ecc e JOIN big b ON e.g = b.g AND e.comp = b.comp GROUP BY e.g)"""
CLUSTER = """,
tri AS (SELECT v, g, count(*) AS c FROM (
  SELECT a.g, unnest([a.s, a.t, b.t]) AS v FROM E a JOIN E b ON a.g = b.g AND a.t = b.s JOIN E c ON c.g = a.g AND c.s = a.s AND c.t = b.t) GROUP BY ALL),
loc AS (SELECT D.*, coalesce(tri.c, 0) AS tr, CASE WHEN d > 1 THEN 2.0 * coalesce(tri.c, 0) / (d * (d - 1)) ELSE 0 END AS cl FROM D LEFT JOIN tri ON D.g = tri.g AND D.v = tri.v),
clu AS (SELECT g, avg(cl) AS ac, CASE WHEN sum(d * (d - 1)) > 0 THEN sum(tr) / sum(d * (d - 1) / 2) ELSE 0 END AS tv, CAST(sum(tr) / 3 AS BIGINT) AS nt FROM loc GROUP BY g)"""
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.when(~F.isnan(c), c), 6)


def g1(spark: SparkSession, sf_dir: str, attrs: bool = False) -> GraphSet:
    return testdata.co_purchases(spark, sf_dir, attrs)


def p1(spark: SparkSession, sf_dir: str, attr: str | None = None) -> GraphSet:
    """g1 with a row a graph, for facts of one graph at a time."""
    return testdata.packed_purchases(spark, sf_dir, attr)


def digest(*parts: Column | str) -> Column:
    """A number below 2**32 from MD5; strings name columns."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def sql_digest(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, 8) AS BIGINT)"


# -- structure ---------------------------------------------------------------------


@query(f"WITH {G1} SELECT g AS graph_id, n AS n_nodes, m AS n_edges, round(CASE WHEN n > 1 AND m > 0 THEN 2.0 * m / (n * (n - 1)) ELSE 0 END, 6) AS density FROM N")
def graph_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.size(g1(spark, sf_dir)).withColumn("density", r6("density"))


@query(f"""WITH {G1}, M AS (SELECT g, avg(d) AS k, stddev_pop(d) AS sd, max(d) AS mx, count(*) AS n FROM D GROUP BY g),
C AS (SELECT D.g, avg((d - k) ** 3) AS m3, avg((d - k) ** 4) AS m4 FROM D JOIN M ON D.g = M.g GROUP BY D.g)
SELECT M.g AS graph_id, round(k, 6) AS mean_degree, CAST(mx AS BIGINT) AS max_degree, round(sd, 6) AS degree_std, round(CASE WHEN k > 0 THEN mx / k ELSE 0 END, 6) AS max_over_mean_degree,
round(CASE WHEN sd > 0 THEN m3 / sd ** 3 ELSE 0 END, 6) AS degree_skewness, round(CASE WHEN sd > 0 THEN m4 / sd ** 4 - 3 ELSE 0 END, 6) AS degree_kurtosis FROM M JOIN C ON M.g = C.g""")
def degree_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["mean_degree", "degree_std", "max_over_mean_degree", "degree_skewness", "degree_kurtosis"]
    return S.degree_moments(g1(spark, sf_dir)).select("graph_id", "max_degree", *[r6(c).alias(c) for c in names])


@query(f"""WITH {G1}, X AS (SELECT g, d, row_number() OVER (PARTITION BY g ORDER BY d) AS i, count(*) OVER (PARTITION BY g) AS n FROM D)
SELECT g AS graph_id, round(CASE WHEN sum(d) > 0 THEN 2.0 * sum(i * d) / (max(n) * sum(d)) - (max(n) + 1) / max(n) ELSE 0 END, 6) AS degree_gini FROM X GROUP BY g""")
def degree_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.degree_gini(g1(spark, sf_dir)).withColumn("degree_gini", r6("degree_gini"))


@query(f"""WITH {G1} SELECT g AS graph_id, CASE WHEN min(d) > 0 THEN round(1 + count(*) / sum(CASE WHEN d > 0 THEN ln(d / 0.5) END), 6) END AS powerlaw_alpha,
CAST(count(*) FILTER (WHERE d = 0) AS BIGINT) AS n_isolates FROM D GROUP BY g""")
def powerlaw_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.degree_moments(g1(spark, sf_dir)).select("graph_id", r6("powerlaw_alpha").alias("powerlaw_alpha"), "n_isolates")


@query(f"WITH {G1}{CLUSTER} SELECT g AS graph_id, round(ac, 6) AS avg_clustering, round(tv, 6) AS transitivity, nt AS n_triangles FROM clu")
def triangles_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    gs = p1(spark, sf_dir)
    caps, beyond = gs.caps, lambda x: S.clustering_sums(x.stored())
    return S.clustering_of(packed.each(gs, lambda g: [packed.sums(g, caps, False)], "graph_id long, avg_clustering double, t long, p double", beyond)).withColumns({c: r6(c) for c in ("avg_clustering", "transitivity")})


@query(f"WITH {G1}{CLUSTER} SELECT g AS graph_id, v AS node_id, CAST(d AS BIGINT) AS deg, CAST(tr AS BIGINT) AS triangles, round(cl, 6) AS clustering FROM loc")
def local_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = packed.each(p1(spark, sf_dir), packed.local_rows, packed.LOCAL, lambda x: S.local_clustering(x.stored()))
    return local.select("graph_id", "node_id", "deg", "triangles", r6("clustering").alias("clustering"))


@query(f"""WITH {G1}, C AS (SELECT a.g, a.t AS u, b.t AS v, count(*) AS c FROM S a JOIN S b ON a.g = b.g AND a.s = b.s AND a.t < b.t GROUP BY ALL)
SELECT N.g AS graph_id, CASE WHEN n <= 400 THEN coalesce(q, 0) END AS n_squares FROM N LEFT JOIN (SELECT g, CAST(sum(c * (c - 1) / 2) / 2 AS BIGINT) AS q FROM C GROUP BY g) x ON N.g = x.g""")
def four_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As its SQL, for graphs of up to 400 nodes."""
    gs = g1(spark, sf_dir)
    return S.four_cycles(replace(gs, caps=replace(gs.caps, squares=400)))


@query(f"""WITH {G1}, X AS (SELECT S.g, a.d AS x, b.d AS y FROM S JOIN D a ON S.g = a.g AND S.s = a.v JOIN D b ON S.g = b.g AND S.t = b.v),
A AS (SELECT g, count(*) AS n, CAST(sum(x) AS DOUBLE) AS sx, CAST(sum(x * x) AS DOUBLE) AS sxx, CAST(sum(x * y) AS DOUBLE) AS sxy FROM X GROUP BY g)
SELECT N.g AS graph_id, round(CASE WHEN A.n * sxx - sx * sx > 0 THEN (A.n * sxy - sx * sx) / (A.n * sxx - sx * sx) END, 6) AS degree_assortativity FROM N LEFT JOIN A ON N.g = A.g""")
def degree_assortativity(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda g: [{"graph_id": g.graph_id, "degree_assortativity": packed.mixing(g)}]
    return packed.each(p1(spark, sf_dir), one, "graph_id long, degree_assortativity double", lambda x: S.degree_assortativity(x.stored())).withColumn("degree_assortativity", r6("degree_assortativity"))


_REACH = f"WITH RECURSIVE {G1}{DIST}, comp AS (SELECT g, s AS v, min(t) AS c FROM dist GROUP BY ALL)"


@query(f"{_REACH} SELECT N.g AS graph_id, CAST(k2 AS BIGINT) AS n_components, CAST(m - n + k2 AS BIGINT) AS n_cycles FROM N JOIN (SELECT g, count(DISTINCT c) AS k2 FROM comp GROUP BY g) x ON N.g = x.g")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    gs = g1(spark, sf_dir).stored()
    counts = kernels.components_of(gs).groupBy("graph_id").agg(F.count_distinct("component").alias("n_components"))
    return S.size(gs).join(counts, "graph_id").select("graph_id", "n_components", S.cyclomatic(F.col("n_nodes"), F.col("n_edges"), F.col("n_components")).alias("n_cycles"))


@query(f"{_REACH} SELECT g AS graph_id, v AS node_id, c AS component FROM comp")
def component_of_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(g: packed.Opened) -> list[dict]:
        return [{"graph_id": g.graph_id, "node_id": v, "component": g.nodes[c]} for v, c in zip(g.nodes, g.components(), strict=True)]

    return packed.each(p1(spark, sf_dir), rows, "graph_id long, node_id string, component string", lambda x: kernels.components_of(x.stored()))


@query(f"WITH RECURSIVE {G1}{DIST}{LCC} SELECT g AS graph_id, round(apl, 6) AS avg_path_length, CAST(diameter AS BIGINT) AS diameter, CAST(radius AS BIGINT) AS radius FROM lcc")
def distances_lcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.kernel_facts(g1(spark, sf_dir), frozenset()).select("graph_id", r6("avg_path_length").alias("avg_path_length"), "diameter", "radius")


@query(f"WITH RECURSIVE {G1}{DIST}{LCC} SELECT g AS graph_id, round(apl, 6) AS avg_path_length, CAST(diameter AS INTEGER) AS diameter, CAST(radius AS INTEGER) AS radius FROM lcc")
def distances_by_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches from all nodes, level by level: of a graph that fits a row in a task, of larger ones by rounds over tables."""
    gs = p1(spark, sf_dir)

    def beyond(large: GraphSet) -> DataFrame:
        large = large.stored()
        return iterative.path_facts(large, iterative.distances(large))

    rows = packed.kernel_rows(replace(gs.caps, paths=gs.caps.dense), frozenset())
    out = packed.each(gs, rows, "graph_id long, avg_path_length double, diameter int, radius int", beyond)
    return out.withColumn("avg_path_length", r6("avg_path_length"))


@query(f"""WITH RECURSIVE {G1}{DIST} SELECT N.g AS graph_id, x.s AS node_id, round(CASE WHEN total > 0 THEN (r * r) / (total * (n - 1)) ELSE 0 END, 6) AS closeness
FROM (SELECT g, s, count(*) - 1 AS r, sum(d) AS total FROM dist GROUP BY ALL) x JOIN N ON x.g = N.g""")
def closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.node_facts(kernels.kernel_facts(g1(spark, sf_dir), frozenset({"closeness"}))).select("graph_id", "node_id", r6("closeness").alias("closeness"))


_BETWEEN = f"""WITH RECURSIVE {G1}{DIST},
P AS (SELECT g, v AS s, v AS t, 0 AS d, CAST(1 AS DOUBLE) AS c FROM V UNION ALL
      SELECT P.g, P.s, S.t, P.d + 1, sum(P.c) FROM P JOIN S ON P.g = S.g AND P.t = S.s JOIN dist ON dist.g = P.g AND dist.s = P.s AND dist.t = S.t AND dist.d = P.d + 1 GROUP BY P.g, P.s, S.t, P.d),
B AS (SELECT a.g, a.t AS v, sum(a.c * b.c / x.c) AS b FROM P a JOIN P b ON a.g = b.g AND a.t = b.s JOIN P x ON x.g = a.g AND x.s = a.s AND x.t = b.t AND x.d = a.d + b.d
      WHERE a.d > 0 AND b.d > 0 GROUP BY ALL),
bc AS (SELECT V.g, V.v, V.p, CASE WHEN n > 2 THEN coalesce(b, 0) / ((n - 1) * (n - 2)) ELSE 0 END AS b FROM V JOIN N ON V.g = N.g LEFT JOIN B ON V.g = B.g AND V.v = B.v)"""


@query(f"{_BETWEEN} SELECT g AS graph_id, v AS node_id, round(b, 6) AS betweenness FROM bc")
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.node_facts(kernels.kernel_facts(g1(spark, sf_dir), frozenset({"betweenness"}))).select("graph_id", "node_id", r6("betweenness").alias("betweenness"))


@query()
def kcore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.node_facts(kernels.kernel_facts(g1(spark, sf_dir), frozenset({"cores"}))).select("graph_id", "node_id", "core")


@query()
def kernel_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities, modularity, cores, spectrum, rings: what SQL cannot express."""
    names = ["n_communities", "modularity", "max_kcore", "spectral_gap", "eigenvector_mean", "eigenvector_max", "eig_degenerate", "ring_sizes"]
    return kernels.kernel_facts(g1(spark, sf_dir)).select("graph_id", *names)


@query(f"""WITH RECURSIVE {G1}{DIST}{LCC}{CLUSTER},
X AS (SELECT N.g, n, m, k, ac, CASE WHEN n > 1 AND m > 0 THEN 2.0 * m / (n * (n - 1)) ELSE 0 END AS dens, apl, k2,
      CASE WHEN k > 0 THEN (k2 - k) ** 2 / (n * k ** 3) ELSE 0 END AS cc
      FROM N JOIN clu ON N.g = clu.g JOIN lcc ON N.g = lcc.g JOIN (SELECT g, avg(d * d) AS k2 FROM D GROUP BY g) q ON N.g = q.g)
SELECT g AS graph_id, round(CASE WHEN dens > 0 THEN ac / dens END, 6) AS er_clustering_ratio, round(cc, 6) AS config_clustering, round(CASE WHEN cc > 0 THEN ac / cc END, 6) AS config_clustering_ratio,
round(CASE WHEN dens > 0 AND apl > 0 AND k > 1 THEN (ac / dens) / (apl / (ln(n) / ln(k))) END, 5) AS smallworld_sigma,
round(CASE WHEN apl > 0 AND k > 1 AND k <> 2 THEN (ln(n) / ln(k)) / apl - ac / (3 * (k - 2) / (4 * (k - 1))) END, 5) AS smallworld_omega FROM X""")
def null_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = facts_.structure(p1(spark, sf_dir), "DJ")
    five = lambda c: F.round(F.when(~F.isnan(c), F.col(c)), 5).alias(c)
    return out.select("graph_id", *[r6(c).alias(c) for c in ("er_clustering_ratio", "config_clustering", "config_clustering_ratio")], five("smallworld_sigma"), five("smallworld_omega"))


@query(f"""WITH {G1} SELECT g AS graph_id, CAST(r AS INTEGER) AS rank, v AS node_id, CAST(d AS BIGINT) AS deg
FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY d DESC, v) AS r FROM D) WHERE r <= 5""")
def topk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_nodes(g1(spark, sf_dir).degrees, "deg").select("graph_id", "rank", "node_id", "deg")


@query(f"WITH {G1} SELECT g AS graph_id, arg_min(v, {{'d': d, 'v': v}}) AS min_degree_node, CAST(count(*) FILTER (WHERE d = 0) AS BIGINT) AS n_isolates FROM D GROUP BY g")
def degree_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.degree_extremes(g1(spark, sf_dir))


@query(f"WITH {G1} SELECT g AS graph_id, v AS node_id, CAST(rank() OVER (PARTITION BY g ORDER BY d DESC) AS INTEGER) AS rank, CAST(d AS BIGINT) AS deg FROM D")
def node_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.ranked_nodes(g1(spark, sf_dir).degrees).select("graph_id", "node_id", "rank", "deg")


@query(f"WITH {G1} SELECT D.g AS graph_id, round(avg(CASE WHEN d > 2 * k THEN 1 ELSE 0 END), 6) AS frac_hubs FROM D JOIN N ON D.g = N.g GROUP BY D.g")
def hub_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hub_share(g1(spark, sf_dir)).withColumn("frac_hubs", r6("frac_hubs"))


@query(f"WITH {G1} SELECT g AS graph_id, s AS node_id, array_to_string(list_sort(list(t)), ',') AS neighbors FROM S GROUP BY ALL")
def neighbor_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.neighbor_lists(g1(spark, sf_dir)).withColumn("neighbors", F.array_join("neighbors", ","))


@query(f"""WITH {G1}, M AS (SELECT g, count(*) AS n, CAST(sum(d) / 2 AS BIGINT) AS m, avg(d) AS k, stddev_pop(d) AS sd, max(d) AS mx FROM D GROUP BY g)
SELECT g AS graph_id, round(CASE WHEN n > 1 AND m > 0 THEN 2.0 * m / (n * (n - 1)) ELSE 0 END, 6) AS f0, round(k, 6) AS f1, CAST(mx AS DOUBLE) AS f2, round(sd, 6) AS f3 FROM M""")
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the vector of groups A and B: density, mean, max and standard deviation of the degree; feature_vector_all has the others."""
    table = S.degree_moments(g1(spark, sf_dir)).withColumns({"n_components": F.lit(None).cast("long"), "degree_gini": F.lit(None).cast("double")})
    vector = table.select("graph_id", feature_column("AB").alias("x"))
    return vector.select("graph_id", r6(F.col("x")[2]).alias("f0"), r6(F.col("x")[4]).alias("f1"), F.col("x")[5].alias("f2"), r6(F.col("x")[6]).alias("f3"))


_IN_SQL = [n for n in feature_names() if n not in ("n_communities", "modularity", "max_kcore", "spectral_gap", "eigenvector_mean", "eigenvector_max")]


@query(f"""{_BETWEEN}{LCC}{CLUSTER}, comp AS (SELECT g, count(DISTINCT c) AS nc FROM (SELECT g, s, min(t) AS c FROM dist GROUP BY ALL) GROUP BY g),
pw AS (SELECT g, CAST(count(*) AS HUGEINT) AS n, sum(d) AS s1, sum(d * d) AS s2, sum(d * d * d) AS s3, sum(d * d * d * d) AS s4, max(d) AS mx, min(d) AS mn, sum(CASE WHEN d > 0 THEN ln(d / 0.5) END) AS ls FROM D GROUP BY g),
mo AS (SELECT *, CAST(n * s2 - s1 * s1 AS DOUBLE) AS a2, CAST(n * n * s3 - 3 * n * s1 * s2 + 2 * s1 * s1 * s1 AS DOUBLE) AS a3, CAST(n * n * n * s4 - 4 * n * n * s1 * s3 + 6 * n * s1 * s1 * s2 - 3 * s1 * s1 * s1 * s1 AS DOUBLE) AS a4 FROM pw),
gi AS (SELECT g, CASE WHEN sum(d) > 0 THEN 2.0 * sum(i * d) / (max(n) * sum(d)) - (max(n) + 1) / max(n) ELSE 0 END AS gini FROM (SELECT g, d, row_number() OVER (PARTITION BY g ORDER BY d) AS i, count(*) OVER (PARTITION BY g) AS n FROM D) GROUP BY g),
sq AS (SELECT g, sum(c * (c - 1) / 2) / 2 AS q FROM (SELECT a.g, a.t AS u, b.t AS v, count(*) AS c FROM S a JOIN S b ON a.g = b.g AND a.s = b.s AND a.t < b.t GROUP BY ALL) GROUP BY g),
xy AS (SELECT S.g, CAST(sum(a.d * b.d) AS DOUBLE) AS sxy, CAST(sum(a.d) AS DOUBLE) AS sx, CAST(sum(a.d * a.d) AS DOUBLE) AS sxx, count(*) AS e FROM S JOIN D a ON S.g = a.g AND S.s = a.v JOIN D b ON S.g = b.g AND S.t = b.v GROUP BY S.g),
cl2 AS (SELECT x.g, avg(CASE WHEN total > 0 THEN (r * r) / (total * (n - 1)) ELSE 0 END) AS cm FROM (SELECT g, s, count(*) - 1 AS r, sum(d) AS total FROM dist GROUP BY ALL) x JOIN N ON x.g = N.g GROUP BY x.g),
bt AS (SELECT g, avg(b) AS bm, max(b) AS bx FROM bc GROUP BY g),
f AS (SELECT N.g, N.n, N.m, N.k, CASE WHEN N.n > 1 AND m > 0 THEN 2.0 * m / (N.n * (N.n - 1)) ELSE 0 END AS dens, nc, mx, sqrt(a2) / N.n AS sd, CASE WHEN a2 > 0 THEN a3 / a2 ** 1.5 ELSE 0 END AS sk, CASE WHEN a2 > 0 THEN a4 / a2 ** 2 - 3 ELSE 0 END AS ku, gini,
 CASE WHEN mn > 0 THEN 1 + N.n / ls END AS alpha, ac, tv, nt, coalesce(q, 0) AS q, apl, diameter, radius, CASE WHEN e * sxx - sx * sx > 0 THEN (e * sxy - sx * sx) / (e * sxx - sx * sx) END AS das, bm, bx, cm,
 CASE WHEN N.k > 0 THEN (s2 / N.n - N.k) ** 2 / (N.n * N.k ** 3) ELSE 0 END AS cc
 FROM N JOIN comp ON N.g = comp.g JOIN mo ON N.g = mo.g JOIN gi ON N.g = gi.g JOIN clu ON N.g = clu.g LEFT JOIN sq ON N.g = sq.g JOIN lcc ON N.g = lcc.g LEFT JOIN xy ON N.g = xy.g JOIN bt ON N.g = bt.g JOIN cl2 ON N.g = cl2.g),
h AS (SELECT g AS graph_id, n AS n_nodes, m AS n_edges, dens AS density, nc AS n_components, k AS mean_degree, mx AS max_degree, sd AS degree_std, CASE WHEN k > 0 THEN mx / k ELSE 0 END AS max_over_mean_degree, sk AS degree_skewness, ku AS degree_kurtosis,
 gini AS degree_gini, alpha AS powerlaw_alpha, ac AS avg_clustering, tv AS transitivity, nt AS n_triangles, q AS n_squares, apl AS avg_path_length, diameter, radius, das AS degree_assortativity, m - n + nc AS n_cycles, bm AS betweenness_mean, bx AS betweenness_max, cm AS closeness_mean,
 CASE WHEN dens > 0 THEN ac / dens END AS er_clustering_ratio, cc AS config_clustering, CASE WHEN cc > 0 THEN ac / cc END AS config_clustering_ratio, CASE WHEN dens > 0 AND apl > 0 AND k > 1 THEN (ac / dens) / (apl / (ln(n) / ln(k))) END AS smallworld_sigma,
 CASE WHEN apl > 0 AND k > 1 AND k <> 2 THEN (ln(n) / ln(k)) / apl - ac / (3 * (k - 2) / (4 * (k - 1))) END AS smallworld_omega FROM f)
SELECT graph_id, {", ".join(f"round(coalesce(CAST({n} AS DOUBLE), 0), 5) AS {n}" for n in _IN_SQL)} FROM h""")
def feature_vector_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector's entries, but for the six that SQL cannot express."""
    parts = frozenset({"betweenness", "closeness"})
    vector = facts_.structure(p1(spark, sf_dir), parts=parts).select("graph_id", feature_column().alias("x"))
    return vector.select("graph_id", *[F.round(F.col("x")[feature_names().index(n)], 5).alias(n) for n in _IN_SQL])


@query()
def all_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature vectors of all groups."""
    return facts_.structure(p1(spark, sf_dir), parts=kernels.PARTS - {"rings"}).select("graph_id", feature_column().alias("features"))


@query()
def verbalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections: structure, key nodes and every node's detail, the attribute; no sentence tells ring sizes."""
    return render.verbalize(facts_.facts(p1(spark, sf_dir, "type"), ["type"], rings=False))


@query()
def verbalize_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    office = render.verbalize(facts_.facts(builtin.office(spark, 0), ["dept", "seniority"]))
    return office.unionByName(render.verbalize(facts_.facts(builtin.molecule(spark, 1), ["atom"])))


@query()
def node_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node in a few sentences."""
    gs, key = p1(spark, sf_dir), ["graph_id", "node_id"]

    def beyond(large: GraphSet) -> DataFrame:
        large = large.stored()
        deep = kernels.node_facts(kernels.kernel_facts(large, frozenset({"betweenness", "eigenvector"}))).select(*key, "betweenness", "eigenvector")
        rows = render.ranked_nodes(S.local_clustering(large)).join(deep, key, "left")
        return rows.join(S.neighbor_lists(large).withColumnRenamed("neighbors", "near"), key, "left")

    return render.node_sentences(packed.each(gs, packed.node_rows(gs.caps), packed.NODES, beyond))


# -- attributes --------------------------------------------------------------------

ATTR = G1 + ", A AS (SELECT V.g, V.v, p_type AS a, p_brand AS b FROM V JOIN part ON p_partkey = V.p), L AS (SELECT E.g, E.s, E.t, x.a AS sa, y.a AS ta FROM E JOIN A x ON E.g = x.g AND E.s = x.v JOIN A y ON E.g = y.g AND E.t = y.v)"


@query(f"WITH {ATTR} SELECT g AS graph_id, a AS val, c AS count, round(c / sum(c) OVER (PARTITION BY g), 6) AS share FROM (SELECT g, a, count(*) AS c FROM A GROUP BY ALL)")
def attr_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.composition(g1(spark, sf_dir, True), "type").withColumn("share", r6("share"))


@query(f"""WITH {ATTR}, M AS (SELECT g, count(*) * 2 AS e, 2 * count(*) FILTER (WHERE sa = ta) AS t FROM L GROUP BY g),
Q AS (SELECT g, CAST(sum(c * c) AS DOUBLE) AS s FROM (SELECT g, a, count(*) AS c FROM (SELECT g, sa AS a FROM L UNION ALL SELECT g, ta FROM L) GROUP BY ALL) GROUP BY g)
SELECT N.g AS graph_id, round(CASE WHEN CAST(e AS DOUBLE) * e - s > 0 THEN (CAST(t AS DOUBLE) * e - s) / (CAST(e AS DOUBLE) * e - s) END, 6) AS attr_assortativity FROM N LEFT JOIN M ON N.g = M.g LEFT JOIN Q ON N.g = Q.g""")
def attr_assortativity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.assortativity(g1(spark, sf_dir, True), "type").withColumn("attr_assortativity", r6("attr_assortativity"))


@query(f"WITH {ATTR} SELECT g AS graph_id, pair, c AS count, round(c / sum(c) OVER (PARTITION BY g), 6) AS share FROM (SELECT g, least(sa, ta) || '-' || greatest(sa, ta) AS pair, count(*) AS c FROM L GROUP BY ALL)")
def edge_type_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes.edge_types(g1(spark, sf_dir, True), "type").withColumn("share", r6("share"))


@query(f"""WITH {ATTR} SELECT N.g AS graph_id, CAST(coalesce(c, 0) AS BIGINT) AS cross_edges, CAST(coalesce(w, 0) AS BIGINT) AS within_edges
FROM N LEFT JOIN (SELECT g, count(*) FILTER (WHERE sa <> ta) AS c, count(*) FILTER (WHERE sa = ta) AS w FROM L GROUP BY g) x ON N.g = x.g""")
def cross_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(g: packed.Opened) -> list[dict]:
        values = g.values("type")
        cross = sum(values[u] != values[v] for u, v in g.edges)
        return [{"graph_id": g.graph_id, "cross_edges": cross, "within_edges": len(g.edges) - cross}]

    return packed.each(p1(spark, sf_dir, "type"), rows, "graph_id long, cross_edges long, within_edges long", lambda x: attributes.cross_edges(x, "type"))


@query(f"WITH {ATTR} SELECT g AS graph_id, array_to_string(list_sort(list(s || '-' || t)), ' ') AS ties FROM L WHERE sa <> ta GROUP BY g")
def cross_edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attributes.cross_edge_list(g1(spark, sf_dir, True), "type")
    return rows.select("graph_id", F.array_join(F.array_sort(F.transform("edges", lambda e: F.concat(e["src"], F.lit("-"), e["dst"]))), " ").alias("ties"))


@query(f"""{_REACH.replace(G1, ATTR)}, X AS (SELECT A.g, comp.c, a, count(*) AS k FROM A JOIN comp ON A.g = comp.g AND A.v = comp.v GROUP BY ALL)
SELECT g AS graph_id, round(sum(most) / sum(total), 6) AS community_purity FROM (SELECT g, c, max(k) AS most, sum(k) AS total FROM X GROUP BY ALL) GROUP BY g""")
def community_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(g: packed.Opened) -> list[dict]:
        share = packed.purity(g, g.values("type"), g.components())
        return [] if share is None else [{"graph_id": g.graph_id, "community_purity": share}]

    def beyond(large: GraphSet) -> DataFrame:
        large = large.stored()
        return attributes.purity(large, "type", iterative.components(large).withColumnRenamed("component", "community"))

    return packed.each(p1(spark, sf_dir, "type"), rows, "graph_id long, community_purity double", beyond).withColumn("community_purity", r6("community_purity"))


@query(f"""WITH {ATTR}, I AS (SELECT g, sa AS c, count(*) AS l FROM L WHERE sa = ta GROUP BY ALL), X AS (SELECT D.g, A.a AS c, sum(d) AS d FROM D JOIN A ON D.g = A.g AND D.v = A.v GROUP BY ALL)
SELECT N.g AS graph_id, round(coalesce(sum(CASE WHEN m > 0 THEN coalesce(l, 0) / m - (d / (2 * m)) ** 2 END), 0), 6) AS modularity FROM X JOIN N ON X.g = N.g LEFT JOIN I ON I.g = X.g AND I.c = X.c GROUP BY N.g""")
def modularity_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(g: packed.Opened) -> list[dict]:
        values = g.values("type")
        return [{"graph_id": g.graph_id, "modularity": packed.modularity(g, values)}] if any(v is not None for v in values) else []

    def beyond(large: GraphSet) -> DataFrame:
        large = large.stored()
        return S.modularity(large, attributes.values(large, "type"), "val")

    return packed.each(p1(spark, sf_dir, "type"), rows, "graph_id long, modularity double", beyond).withColumn("modularity", r6("modularity"))


@query(f"{_BETWEEN.replace(G1, ATTR)} SELECT bc.g AS graph_id, A.a AS val, round(avg(bc.b), 6) AS mean FROM bc JOIN A ON bc.g = A.g AND bc.v = A.v GROUP BY ALL")
def group_mean_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    gs = g1(spark, sf_dir, True).stored()
    return attributes.mean_by_group(gs, "type", kernels.node_facts(kernels.kernel_facts(gs, frozenset({"betweenness"})))).withColumn("mean", r6("mean"))


_ONE = """P AS (SELECT DISTINCT l_orderkey AS o, CAST(l_partkey AS VARCHAR) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
E AS (SELECT least(a.v, b.v) AS s, greatest(a.v, b.v) AS t FROM P a JOIN P b ON a.o = b.o AND a.v < b.v GROUP BY ALL HAVING count(*) >= 2),
S AS (SELECT s, t FROM E UNION ALL SELECT t, s FROM E), D AS (SELECT s AS v, count(*) AS d FROM S GROUP BY s)"""


@query(f"WITH {_ONE} SELECT v AS node_id, d AS deg FROM D")
def one_graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of one graph over all parts."""
    return testdata.part_pairs(spark, sf_dir).degrees.select("node_id", "deg")


@query(f"""WITH RECURSIVE {_ONE}, W AS (SELECT v AS s, v AS t FROM D UNION SELECT W.s, S.t FROM W JOIN S ON W.t = S.s)
SELECT s AS node_id, min(t) AS component FROM W GROUP BY s""")
def one_graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of one graph over all parts, by rounds over tables."""
    return iterative.components(testdata.part_pairs(spark, sf_dir).stored()).select("node_id", "component")


@query(f"""WITH {_ONE}, X AS (SELECT s, t, a.d AS x, b.d AS y FROM E JOIN D a ON E.s = a.v JOIN D b ON E.t = b.v),
A AS (SELECT 2 * count(*) AS n, CAST(sum(x + y) AS DOUBLE) AS sx, CAST(sum(x * x + y * y) AS DOUBLE) AS sxx, CAST(2 * sum(x * y) AS DOUBLE) AS sxy FROM X)
SELECT round(CASE WHEN n * sxx - sx * sx > 0 THEN (n * sxy - sx * sx) / (n * sxx - sx * sx) END, 6) AS degree_assortativity FROM A""")
def one_graph_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.degree_assortativity(testdata.part_pairs(spark, sf_dir).stored()).select(r6("degree_assortativity").alias("degree_assortativity"))


@query()
def one_graph_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cores of one graph over all parts, by rounds over tables."""
    return iterative.core_numbers(testdata.part_pairs(spark, sf_dir).stored()).select("node_id", "core")


_BANDS = """SELECT n_nationkey AS nation, round(n_nationkey / 12.5 - 1, 6) AS value,
CASE WHEN n_nationkey / 12.5 - 1 >= 0.6 THEN 'strongly homophilous' WHEN n_nationkey / 12.5 - 1 >= 0.3 THEN 'moderately homophilous' WHEN n_nationkey / 12.5 - 1 >= 0.1 THEN 'weakly homophilous'
WHEN n_nationkey / 12.5 - 1 >= -0.1 THEN 'mixed (no homophily)' ELSE 'heterophilous (ties tend to cross groups)' END AS homophily,
CASE WHEN n_nationkey / 24 >= 0.9 THEN 'almost exactly' WHEN n_nationkey / 24 >= 0.75 THEN 'closely' WHEN n_nationkey / 24 >= 0.6 THEN 'loosely' ELSE 'only weakly' END AS correspondence FROM nation"""


@query(_BANDS)
def homophily_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = testdata.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    value = F.col("nation") / 12.5 - 1
    return n.select("nation", F.round(value, 6).alias("value"), words.homophily_column(value).alias("homophily"), words.correspondence_column(F.col("nation") / 24).alias("correspondence"))


# -- neighbourhoods and links ------------------------------------------------------

_TOP = ", T AS (SELECT * FROM (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY d DESC, v) AS r FROM D))"
_HOPS = """, H AS (SELECT T.g, T.v AS s, T.v AS t, 0 AS d FROM T WHERE {seeds} UNION SELECT H.g, H.s, S.t, H.d + 1 FROM H JOIN S ON H.g = S.g AND H.t = S.s WHERE H.d < 2),
near AS (SELECT g, t AS v, min(d) AS d FROM H GROUP BY ALL), pick AS (SELECT * FROM (SELECT near.*, row_number() OVER (PARTITION BY near.g ORDER BY near.d, {place}, near.v) - 1 AS i FROM near {join}) WHERE i < {cap})"""


def targets(gs: GraphSet, k: int = 1) -> DataFrame:
    return S.top_nodes(gs.degrees, "deg", k).select("graph_id", "node_id", "rank")


@query(f"""WITH RECURSIVE {G1}{_TOP}{_HOPS.format(seeds="T.r = 1", place="near.d", join="", cap=25)}
SELECT p.g AS graph_id, count(*) AS n_nodes, CAST(coalesce(max(m), 0) AS BIGINT) AS n_edges, array_to_string(list_sort(list(v)), ',') AS members
FROM pick p LEFT JOIN (SELECT E.g, count(*) AS m FROM E JOIN pick a ON E.g = a.g AND E.s = a.v JOIN pick b ON E.g = b.g AND E.t = b.v GROUP BY E.g) x ON p.g = x.g GROUP BY p.g""")
def ego_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    def beyond(gs: GraphSet) -> DataFrame:
        gs = gs.stored()
        ego, members = neighborhoods.ego_graphs(gs, targets(gs).withColumn("seed_id", F.col("graph_id")))
        lists = members.groupBy(F.col("seed_id").alias("graph_id")).agg(F.array_join(F.array_sort(F.collect_list("node_id")), ",").alias("members"))
        return S.size(ego).drop("density").join(lists, "graph_id")

    rows = lambda g: [packed.neighbourhood(g, g.top(1), 25)]
    return packed.each(p1(spark, sf_dir), rows, "graph_id long, n_nodes long, n_edges long, members string", beyond)


@query(f"""WITH RECURSIVE {G1}{_TOP}{_HOPS.format(seeds="T.r <= 2", place="coalesce(T.r, 9)", join="LEFT JOIN T ON T.g = near.g AND T.v = near.v AND T.r <= 2", cap=30)},
two AS (SELECT g FROM T GROUP BY g HAVING count(*) >= 2)
SELECT p.g AS graph_id, count(*) AS n_nodes, CAST(coalesce(max(m), 0) AS BIGINT) AS n_edges FROM pick p JOIN two ON p.g = two.g
LEFT JOIN (SELECT E.g, count(*) AS m FROM E JOIN pick a ON E.g = a.g AND E.s = a.v JOIN pick b ON E.g = b.g AND E.t = b.v WHERE NOT (a.i < 2 AND b.i < 2) GROUP BY E.g) x ON p.g = x.g GROUP BY p.g""")
def joint_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    def beyond(gs: GraphSet) -> DataFrame:
        gs = gs.stored()
        joint, _ = neighborhoods.joint_graphs(gs, top_pairs(gs).withColumn("seed_id", F.col("graph_id")))
        return S.size(joint).drop("density")

    rows = lambda g: [packed.neighbourhood(g, g.top(2), 30, True)] if g.n > 1 else []
    return packed.each(p1(spark, sf_dir), rows, "graph_id long, n_nodes long, n_edges long", beyond)


def top_pairs(gs: GraphSet) -> DataFrame:
    """graph_id, u, v: the two nodes of largest degree."""
    return targets(gs, 2).groupBy("graph_id").agg(F.max_by("node_id", -F.col("rank")).alias("u"), F.max_by("node_id", "rank").alias("v")).filter(F.col("u") != F.col("v"))


_PAIR = ", pr AS (SELECT a.g, a.v AS u, b.v FROM T a JOIN T b ON a.g = b.g AND a.r = 1 AND b.r = 2)"


@query(f"WITH {G1}{_TOP}{_PAIR} SELECT E.g AS graph_id, count(*) AS n_edges FROM E LEFT JOIN pr ON E.g = pr.g AND E.s = least(pr.u, pr.v) AND E.t = greatest(pr.u, pr.v) WHERE pr.g IS NULL GROUP BY E.g")
def observed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(g: packed.Opened) -> list[dict]:
        top = g.top(2)
        m = len(g.edges) - (len(top) > 1 and top[1] in g.near[top[0]])
        return [{"graph_id": g.graph_id, "n_edges": m}] if m else []

    def beyond(gs: GraphSet) -> DataFrame:
        gs = gs.stored()
        return neighborhoods.observed(gs, top_pairs(gs)).edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"))

    return packed.each(p1(spark, sf_dir), rows, "graph_id long, n_edges long", beyond)


@query(f"""WITH RECURSIVE {G1}{_TOP}{_PAIR},
O AS (SELECT S.* FROM S LEFT JOIN pr ON S.g = pr.g AND ((S.s = pr.u AND S.t = pr.v) OR (S.s = pr.v AND S.t = pr.u)) WHERE pr.g IS NULL),
OD AS (SELECT g, s AS v, count(*) AS d FROM O GROUP BY ALL),
cn AS (SELECT pr.g, count(*) AS cn, sum(CASE WHEN d > 1 THEN 1 / ln(d) END) AS aa, sum(1.0 / d) AS ra FROM pr JOIN O a ON a.g = pr.g AND a.s = pr.u JOIN O b ON b.g = pr.g AND b.s = pr.v AND b.t = a.t JOIN OD ON OD.g = pr.g AND OD.v = a.t GROUP BY pr.g),
Wk AS (SELECT g, u AS t, 0 AS d FROM pr UNION SELECT Wk.g, O.t, Wk.d + 1 FROM Wk JOIN O ON Wk.g = O.g AND Wk.t = O.s WHERE Wk.d < 14),
X AS (SELECT pr.*, coalesce(cn, 0) AS c, coalesce(aa, 0) AS aa, coalesce(ra, 0) AS ra, coalesce(du.d, 0) AS du, coalesce(dv.d, 0) AS dv, coalesce(w.d, -1) AS sp FROM pr LEFT JOIN cn ON cn.g = pr.g LEFT JOIN OD du ON du.g = pr.g AND du.v = pr.u
 LEFT JOIN OD dv ON dv.g = pr.g AND dv.v = pr.v LEFT JOIN (SELECT g, t, min(d) AS d FROM Wk GROUP BY ALL) w ON w.g = pr.g AND w.t = pr.v)
SELECT g AS graph_id, u, v, c AS common_neighbors, round(CASE WHEN du + dv - c > 0 THEN c / (du + dv - c) ELSE 0 END, 6) AS jaccard, round(aa, 6) AS adamic_adar, round(ra, 6) AS resource_allocation,
CAST(du * dv AS BIGINT) AS preferential_attachment, CAST(sp AS INTEGER) AS shortest_path FROM X""")
def link_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    def beyond(gs: GraphSet) -> DataFrame:
        gs = gs.stored()
        pairs = top_pairs(gs)
        return links.link_features(neighborhoods.observed(gs, pairs).stored(), pairs)

    out = packed.each(p1(spark, sf_dir), packed.top_link(True), packed.LINK, beyond)
    return out.withColumns({c: r6(c) for c in ("jaccard", "adamic_adar", "resource_allocation")})


_KNOWN = f", K AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY {sql_digest('7', 'v')}, v) <= floor(0.5 * count(*) OVER (PARTITION BY g)) AS known FROM V)"


@query(f"WITH {G1}{_KNOWN} SELECT g AS graph_id, v AS node_id, known FROM K")
def known_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.known_mask(g1(spark, sf_dir).vertices, 7)


@query(f"""WITH {ATTR}{_KNOWN}, KA AS (SELECT A.g, A.v, A.a FROM A JOIN K ON A.g = K.g AND A.v = K.v AND known),
C AS (SELECT S.g, S.s AS v, KA.a, count(*) AS c FROM S JOIN KA ON S.g = KA.g AND S.t = KA.v GROUP BY ALL),
best AS (SELECT g, v, a FROM (SELECT *, row_number() OVER (PARTITION BY g, v ORDER BY c DESC, a) AS r FROM C) WHERE r = 1),
common AS (SELECT g, a FROM (SELECT g, a, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, a) AS r FROM KA GROUP BY g, a) WHERE r = 1)
SELECT V.g AS graph_id, V.v AS node_id, coalesce(best.a, common.a) AS vote FROM V LEFT JOIN best ON V.g = best.g AND V.v = best.v LEFT JOIN common ON V.g = common.g""")
def neighbor_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    gs = g1(spark, sf_dir, True)
    known = splits.known_mask(gs.vertices, 7).filter("known")
    return links.neighbour_labels(gs, attributes.values(gs, "type").withColumnRenamed("val", "label"), TYPES, known).select("graph_id", "node_id", "vote")


@query(f"WITH {ATTR} SELECT g AS graph_id, round(count(*) FILTER (WHERE a = 'ECONOMY') / count(*), 6) AS economy, round(count(*) FILTER (WHERE a = 'STANDARD') / count(*), 6) AS standard FROM A GROUP BY g")
def type_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = links.type_composition(g1(spark, sf_dir, True), "type", TYPES)
    return c.select("graph_id", r6(F.col("composition")[0]).alias("economy"), r6(F.col("composition")[5]).alias("standard"))


@query(f"WITH {G1} SELECT N.g AS graph_id, 'edges: ' || coalesce(x, '') AS text FROM N LEFT JOIN (SELECT g, string_agg('(' || s || ',' || t || ')', ', ' ORDER BY s, t) AS x FROM E GROUP BY g) y ON N.g = y.g")
def edge_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda g: [{"graph_id": g.graph_id, "text": packed.edge_text(g)}]
    return packed.each(p1(spark, sf_dir), rows, "graph_id long, text string", neighborhoods.edge_text)


@query(f"WITH {G1} SELECT g AS graph_id, d AS deg, count(*) AS n FROM D GROUP BY ALL")
def permuted_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permuting labels leaves the degree histogram as it is."""
    return neighborhoods.permuted(g1(spark, sf_dir), 3).degrees.groupBy("graph_id", "deg").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM e WHERE v <> 0)
SELECT vec_id, string_agg('w' || i, ',' ORDER BY k) AS features FROM r WHERE k <= 8 GROUP BY vec_id""")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = testdata.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return neighborhoods.top_features(rows).select("vec_id", "features")


@query(r"""WITH t AS (SELECT doc_id, replace(trim(text, ' '), chr(10), ' ') AS x FROM documents)
SELECT doc_id, CASE WHEN length(x) > 320 THEN regexp_replace(substr(x, 1, 320), ' [^ ]*$', '') || ' ...' ELSE x END AS text FROM t""")
def shortened_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.table(spark, sf_dir, "documents").select("doc_id", neighborhoods.shortened(F.col("text")).alias("text"))


# -- splits ------------------------------------------------------------------------

_SEGMENTS = "C AS (SELECT DISTINCT c_custkey AS id, c_mktsegment AS label FROM customer JOIN orders ON o_custkey = c_custkey)"


@query(f"""WITH {_SEGMENTS}, X AS (SELECT *, unnest([11, 22, 33]) AS seed FROM C),
Y AS (SELECT *, row_number() OVER (PARTITION BY seed, label ORDER BY {sql_digest('seed', 'id')}, id) AS r FROM X),
Z AS (SELECT *, CASE WHEN r <= 5 THEN 'shot' ELSE 'query' END AS role FROM Y),
O AS (SELECT *, row_number() OVER (PARTITION BY seed, role ORDER BY {sql_digest('seed + 1000003', 'id')}, id) - 1 AS ord FROM Z)
SELECT seed, id, label, role, CAST(ord AS INTEGER) AS ord FROM O WHERE role = 'shot' OR ord < 40""")
def fewshot_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = testdata.customers(spark, sf_dir)
    return splits.few_shot(graphs, [11, 22, 33], splits.shots_per_class(5))


@query(f"""WITH X AS (SELECT CAST(p_partkey AS VARCHAR) AS node_id, p_type AS label, unnest([11, 22]) AS seed FROM part),
Y AS (SELECT *, row_number() OVER (PARTITION BY seed, label ORDER BY {sql_digest('seed', 'node_id')}, node_id) AS k FROM X),
Z AS (SELECT *, CASE WHEN k <= 5 THEN 'shot' ELSE 'query' END AS role FROM Y WHERE k <= 10), O AS (SELECT *, row_number() OVER (PARTITION BY seed, role ORDER BY k, label) AS n FROM Z)
SELECT seed, node_id, label, role, CASE WHEN role = 'shot' THEN CAST(k AS INTEGER) END AS k FROM O WHERE role = 'shot' OR n <= 30""")
def node_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = testdata.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("node_id"), F.col("p_type").alias("label"))
    return splits.node_split(parts, [11, 22], 5, 30, 6)


@query(f"""WITH {G1}, X AS (SELECT g, s AS u, t AS v, row_number() OVER (PARTITION BY g ORDER BY {sql_digest('11', 's', 't')}, s, t) - 1 AS ord FROM E)
SELECT g AS graph_id, u, v, CAST(ord AS INTEGER) AS ord FROM X WHERE ord < 5""")
def positive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.positive_pairs(g1(spark, sf_dir), 11, 5)


@query(f"""WITH {G1}, I AS (SELECT unnest(range(8)) AS i),
A AS (SELECT g, v, i, row_number() OVER (PARTITION BY g, i ORDER BY {sql_digest('11 * 1009 + 2 * i', 'v')}, v) AS at FROM D, I WHERE d > 0),
B AS (SELECT g, v, i, row_number() OVER (PARTITION BY g, i ORDER BY {sql_digest('11 * 1009 + 2 * i + 1', 'v')}, v) AS at FROM D, I WHERE d > 0),
P AS (SELECT DISTINCT A.g, least(A.v, B.v) AS u, greatest(A.v, B.v) AS v FROM A JOIN B ON A.g = B.g AND A.i = B.i AND A.at = B.at AND A.v <> B.v),
F AS (SELECT P.* FROM P LEFT JOIN E ON P.g = E.g AND P.u = E.s AND P.v = E.t WHERE E.g IS NULL),
X AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {sql_digest('11', 'u', 'v')}, u, v) - 1 AS ord FROM F)
SELECT g AS graph_id, u, v, CAST(ord AS INTEGER) AS ord FROM X WHERE ord < 5""")
def negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.each(p1(spark, sf_dir), packed.negative_pairs(11, 5), "graph_id long, u string, v string, ord int", lambda x: splits.negative_pairs(x.stored(), 11, 5))


@query(f"""WITH {_SEGMENTS}, X AS (SELECT id, row_number() OVER (ORDER BY {sql_digest('11', 'id')}, id) - 1 AS ord FROM C)
SELECT id, CASE WHEN ord < 10 THEN 'shot' ELSE 'query' END AS role, CAST(ord AS INTEGER) AS ord FROM X WHERE ord < 22
UNION ALL SELECT id, 'train', CAST(ord AS INTEGER) FROM X WHERE ord < 10 OR (ord >= 22 AND ord < 412)""")
def regression_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.regression_split(testdata.customers(spark, sf_dir), 11, 10, 12)


@query(f"""WITH {_SEGMENTS}, X AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_digest('5', 'id')}, id) AS r, count(*) OVER (PARTITION BY label) AS n FROM C)
SELECT id AS graph_id, label, r <= greatest(1, round_even(0.25 * n, 0)) AS validation FROM X""")
def validation_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.validation_slice(testdata.customers(spark, sf_dir), 5)


@query("SELECT CAST(0 AS BIGINT) AS differences")
def split_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split does not depend on how the rows are partitioned."""
    graphs = testdata.customers(spark, sf_dir)
    again = graphs.repartition(7)
    return splits.parity(splits.few_shot(graphs, [11], 5), splits.few_shot(again, [11], 5)).agg(F.count(F.lit(1)).alias("differences"))


@query(f"SELECT c_custkey AS qid, CAST(row_number() OVER (ORDER BY {sql_digest('12345', 'c_custkey')}, c_custkey) - 1 AS INTEGER) AS ord FROM customer")
def query_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.query_order(testdata.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid")))


# -- knowledge graphs --------------------------------------------------------------

KG = """T AS (
SELECT 'c:' || c_custkey AS h, 'from' AS r, 'n:' || c_nationkey AS t FROM customer UNION ALL SELECT 's:' || s_suppkey, 's_from', 'n:' || s_nationkey FROM supplier
UNION ALL SELECT 'n:' || n_nationkey, 'in_region', 'r:' || n_regionkey FROM nation UNION ALL SELECT 'p:' || p_partkey, 'brand', 'b:' || p_brand FROM part
UNION ALL SELECT DISTINCT 'p:' || l_partkey, 'supplies', 's:' || l_suppkey FROM lineitem),
K AS (SELECT h, r, t, CAST('0x' || substr(md5(h || '|' || r || '|' || t), 1, 6) AS BIGINT) % 10 AS u FROM T),
ent AS (SELECT DISTINCT e FROM (SELECT h AS e FROM K UNION ALL SELECT t FROM K))"""


@query(f"WITH {KG} SELECT h, r, t, CASE WHEN u < 8 THEN 'train' WHEN u < 9 THEN 'valid' ELSE 'test' END AS split FROM K")
def kg_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.knowledge(spark, sf_dir)


@query(f"WITH {KG}, x AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS id, CAST(length(CAST((SELECT count(*) FROM ent) - 1 AS VARCHAR)) AS INTEGER) AS w FROM ent) SELECT e AS value, id, 'E' || lpad(CAST(id AS VARCHAR), w, '0') AS token FROM x")
def kg_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg.entities(testdata.knowledge(spark, sf_dir))


_ASKED = "q AS (SELECT row_number() OVER (ORDER BY h, r, t) - 1 AS qid, h, r, t FROM K WHERE u = 9)"
_RANKED = f"""WITH {KG}, {_ASKED}, tr AS (SELECT * FROM K WHERE u < 8), te AS (SELECT DISTINCT e FROM (SELECT h AS e FROM tr UNION ALL SELECT t FROM tr)),
al AS (SELECT te.e, count(tr.t) AS n FROM te LEFT JOIN tr ON tr.t = te.e GROUP BY te.e), pr AS (SELECT r, t AS e, count(*) AS c FROM tr GROUP BY ALL),
rk AS (SELECT r.r, al.e, row_number() OVER (PARTITION BY r.r ORDER BY coalesce(c, 0) DESC, n DESC, al.e) AS place FROM (SELECT DISTINCT r FROM q) r CROSS JOIN al LEFT JOIN pr ON pr.r = r.r AND pr.e = al.e)"""


def asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The triples, and all test triples as queries (qid, h, r, t)."""
    triples = testdata.knowledge(spark, sf_dir)
    tests = triples.filter(F.col("split") == "test").select("h", "r", "t")
    return triples, kg.numbered(tests, F.col("h"), F.col("r"), F.col("t"), name="qid", n=testdata.knowledge_parts(spark, sf_dir))


@query(_RANKED + " SELECT q.qid, rk.e AS ent, CAST(place AS INTEGER) AS place FROM q JOIN rk ON q.r = rk.r WHERE place <= 10")
def kg_top_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten likeliest tails of every test triple's relation."""
    triples, queries = asked(spark, sf_dir)
    return kg.frequency_top_tails(triples.filter("split = 'train'"), queries, n=testdata.knowledge_parts(spark, sf_dir))


@query(_RANKED + """, x AS (SELECT q.qid, q.h, q.r, q.t, rk.place FROM q LEFT JOIN rk ON rk.r = q.r AND rk.e = q.t),
ahead AS (SELECT x.qid, count(*) AS n FROM x JOIN (SELECT DISTINCT h, r, t FROM K) o ON o.h = x.h AND o.r = x.r AND o.t <> x.t JOIN rk ON rk.r = x.r AND rk.e = o.t AND rk.place < x.place GROUP BY x.qid),
f AS (SELECT place - coalesce(n, 0) AS rank FROM x LEFT JOIN ahead ON x.qid = ahead.qid)
SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 6) AS hits1, round(avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END), 6) AS hits10, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM f""")
def kg_ranking_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered ranking scores of the frequency prior over all test triples."""
    ranks = kg.frequency_ranks(durable(testdata.knowledge(spark, sf_dir)), testdata.knowledge_parts(spark, sf_dir))
    return metrics.ranking_scores(ranks).select("n", *[r6(c).alias(c) for c in ("hits1", "hits10", "mrr")])


@query(f"WITH {KG} SELECT r FROM K WHERE u < 8 GROUP BY r ORDER BY count(*) DESC, r LIMIT 1")
def kg_commonest_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg.commonest_relation(testdata.knowledge(spark, sf_dir).filter("split = 'train'"))


@query(f"""WITH {KG}, {_ASKED}, inc AS (SELECT h AS e, h, r, t FROM K UNION ALL SELECT t, h, r, t FROM K WHERE t <> h),
x AS (SELECT q.qid, s.side, inc.h, inc.r, inc.t FROM q, LATERAL (SELECT unnest([0, 1]) AS side) s JOIN inc ON inc.e = CASE WHEN s.side = 0 THEN q.h ELSE q.t END
 WHERE NOT ((inc.h = q.h AND inc.t = q.t) OR (inc.h = q.t AND inc.t = q.h))), y AS (SELECT qid, h, r, t, min(side) AS side FROM x GROUP BY ALL),
z AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY side, h, r, t) AS n FROM y)
SELECT q.qid, coalesce(l, '') AS context FROM q LEFT JOIN (SELECT qid, string_agg('(' || h || ') -[' || r || ']-> (' || t || ')', chr(10) ORDER BY n) AS l FROM z WHERE n <= 24 GROUP BY qid) w ON q.qid = w.qid""")
def kg_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples, queries = asked(spark, sf_dir)
    return neighborhoods.typed_context(triples, queries).select("qid", F.array_join("lines", "\n").alias("context"))


@query(f"""WITH {KG}, x AS (SELECT *, least(h, t) AS a, greatest(h, t) AS b, {sql_digest('11', 'h', 'r', 't')} AS w FROM K),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY w, h, r, t) AS p FROM x WHERE u = 9) WHERE p = 1),
qy AS (SELECT h, r, t, a, b, row_number() OVER (ORDER BY w, h, r, t) - 1 AS ord FROM o ORDER BY w, h, r, t LIMIT 40),
sh AS (SELECT x.h, x.r, x.t, row_number() OVER (ORDER BY x.w, x.h, x.r, x.t) - 1 AS ord FROM x LEFT JOIN qy ON x.a = qy.a AND x.b = qy.b WHERE qy.a IS NULL)
SELECT h, r, t, 'query' AS role, CAST(ord AS INTEGER) AS ord FROM qy UNION ALL SELECT h, r, t, 'shot', CAST(ord AS INTEGER) FROM sh WHERE ord < 5""")
def kg_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.triple_split(testdata.knowledge(spark, sf_dir), 11, 5, 40)


@query(f"""WITH {KG}, {_ASKED} SELECT count(*) AS n FROM K LEFT JOIN q ON least(K.h, K.t) = least(q.h, q.t) AND greatest(K.h, K.t) = greatest(q.h, q.t) WHERE q.qid IS NULL""")
def kg_without_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples, queries = asked(spark, sf_dir)
    return neighborhoods.observed_triples(triples, queries).agg(F.count(F.lit(1)).alias("n"))


# -- answers and scores ------------------------------------------------------------

_LINE = f"""SELECT CAST(c_nationkey AS VARCHAR) AS run, CAST(c_custkey AS INTEGER) AS qid, c_mktsegment AS label,
CASE {sql_digest("'guess'", 'c_custkey')} % 4 WHEN 0 THEN 'BUILDING' ELSE c_mktsegment END AS guess, {sql_digest("'form'", 'c_custkey')} % 5 AS form FROM customer"""
_FORMS = """CASE form WHEN 0 THEN qid || ' ' || lower(guess) WHEN 1 THEN 'Query ' || qid || ': ' || guess WHEN 2 THEN qid || ') ' || guess WHEN 3 THEN '  ' || qid || ' - ' || guess || ' ' ELSE qid || ' ' || guess || ' because' END"""


def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = testdata.table(spark, sf_dir, "customer")
    qid = F.col("c_custkey").cast("string")
    guess = F.when(digest(F.lit("guess"), "c_custkey") % 4 == 0, F.lit("BUILDING")).otherwise(F.col("c_mktsegment"))
    form = digest(F.lit("form"), "c_custkey") % 5
    cat = lambda *p: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p])
    line = F.when(form == 0, cat(qid, " ", F.lower(guess))).when(form == 1, cat("Query ", qid, ": ", guess)).when(form == 2, cat(qid, ") ", guess)).when(form == 3, cat("  ", qid, " - ", guess, " ")).otherwise(cat(qid, " ", guess, " because"))
    return c.select(F.col("c_nationkey").cast("string").alias("run"), F.col("c_custkey").cast("int").alias("qid"), F.col("c_mktsegment").alias("label"), F.lit("m").alias("model"), F.lit(0).alias("line_no"), line.alias("line"))


@query(f"WITH a AS ({_LINE}) SELECT run, 'm' AS model, qid, upper(guess) AS token FROM a WHERE form < 4")
def parse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.parse_classes(answer_lines(spark, sf_dir).drop("qid"))


@query(f"""WITH a AS ({_LINE}), h AS (SELECT run, label, avg(CASE WHEN form < 4 AND guess = label THEN 1 ELSE 0 END) AS recall FROM a GROUP BY ALL) SELECT run, round(avg(recall), 6) AS balanced_accuracy FROM h GROUP BY run""")
def balanced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = answer_lines(spark, sf_dir)
    return metrics.balanced_accuracy(lines.select("run", "qid", "label"), answers.parse_classes(lines.drop("qid"))).withColumn("balanced_accuracy", r6("balanced_accuracy"))


@query(f"WITH a AS ({_LINE}) SELECT run, CASE WHEN count(*) FILTER (WHERE form < 4) > 0 THEN round(avg(CASE WHEN form < 4 AND guess = label THEN 1 ELSE 0 END), 6) END AS accuracy FROM a GROUP BY run")
def raw_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = answer_lines(spark, sf_dir)
    return metrics.raw_accuracy(lines.select("run", "qid", "label"), answers.parse_classes(lines.drop("qid"))).withColumn("accuracy", r6("accuracy"))


def _number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = testdata.table(spark, sf_dir, "customer")
    form = digest(F.lit("num"), "c_custkey") % 3
    z = (digest(F.lit("z"), "c_custkey") % 600 - 300).cast("string")
    line = F.when(form == 0, F.concat_ws(" ", "c_custkey", z)).when(form == 1, F.concat(F.col("c_custkey").cast("string"), F.lit(": z="), z, F.lit(".5"))).otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit(") 7 then "), F.translate(z, "-", "−"), F.lit(" kcal")))
    return c.select(F.col("c_nationkey").cast("string").alias("run"), F.lit("m").alias("model"), F.lit(0).alias("line_no"), line.alias("line"), F.col("c_custkey").cast("int").alias("qid"), F.col("c_acctbal").alias("value"))


_NUM = f"""SELECT CAST(c_nationkey AS VARCHAR) AS run, CAST(c_custkey AS INTEGER) AS qid, c_acctbal AS truth, {sql_digest("'num'", 'c_custkey')} % 3 AS form, {sql_digest("'z'", 'c_custkey')} % 600 - 300 AS z FROM customer"""
_NUM_VALUE = "CAST(CASE WHEN form = 1 THEN CAST(z || '.5' AS DOUBLE) ELSE z END AS DOUBLE)"


@query(f"WITH a AS ({_NUM}) SELECT run, 'm' AS model, qid, {_NUM_VALUE} AS value FROM a")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.parse_numbers(_number_lines(spark, sf_dir).drop("qid", "value"))


@query(f"""WITH a AS ({_NUM}), b AS (SELECT run, truth, {_NUM_VALUE} * 1000 + 5000 AS p FROM a), m AS (SELECT run, avg(truth) AS mu FROM b GROUP BY run)
SELECT b.run, count(*) AS n, round(avg(abs(p - truth)), 4) AS mae, round(sqrt(avg((p - truth) ** 2)), 4) AS rmse, round(1 - sum((p - truth) ** 2) / sum((truth - mu) ** 2), 4) AS r2 FROM b JOIN m ON b.run = m.run GROUP BY b.run HAVING count(*) >= 2""")
def regression_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _number_lines(spark, sf_dir)
    truth = lines.select("run", "qid", "value", F.lit(5000.0).alias("zmean"), F.lit(1000.0).alias("zstd"))
    out = metrics.regression_scores(truth, answers.parse_numbers(lines.drop("qid", "value")))
    return out.select("run", "n", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2")])


@query("""SELECT CAST(o_custkey AS VARCHAR) AS run, CAST(o_orderkey AS INTEGER) AS qid, 'm' AS model, CASE WHEN o_orderkey % 7 = o_orderkey % 5 THEN 'E' || o_orderkey % 7 ELSE 'E' || o_orderkey % 7 || ',E' || o_orderkey % 5 END AS ranked FROM orders""")
def parse_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = testdata.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    line = F.concat(k.cast("string"), F.lit(") e"), (k % 7).cast("string"), F.lit(", E"), (k % 5).cast("string"), F.lit(" E"), (k % 7).cast("string"))
    lines = o.select(F.col("o_custkey").cast("string").alias("run"), F.lit("m").alias("model"), F.lit(0).alias("line_no"), line.alias("line"))
    return answers.parse_rankings(lines).withColumn("ranked", F.array_join("ranked", ","))


_SCORES = f"SELECT n_name AS dataset, r_name AS domain, m.method, seed, {sql_digest('n_name', 'm.method', 'seed')} % 1000 / 1000 AS score FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest(['classical', 'majority', 'method']) AS method) m, (SELECT unnest([11, 22, 33]) AS seed) s"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = testdata.table(spark, sf_dir, "nation").join(testdata.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select(F.col("n_name").alias("dataset"), F.col("r_name").alias("domain"), F.explode(F.array(*[F.lit(m) for m in ("classical", "majority", "method")])).alias("method"))
    n = n.withColumn("seed", F.explode(F.array(F.lit(11), F.lit(22), F.lit(33))))
    return n.withColumn("score", (digest("dataset", "method", "seed") % 1000) / 1000)


@query(f"WITH s AS ({_SCORES}) SELECT dataset, method, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM s GROUP BY ALL")
def over_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.over_seeds(scores(spark, sf_dir), ("dataset", "method")).withColumns({c: r6(c) for c in ("mean", "std")})


_WIDE = f"WITH s AS ({_SCORES}), w AS (SELECT dataset, domain, avg(score) FILTER (WHERE method = 'classical') AS classical, avg(score) FILTER (WHERE method = 'majority') AS majority, avg(score) FILTER (WHERE method = 'method') AS method FROM s GROUP BY ALL)"


@query(f"{_WIDE}, r AS (SELECT domain, round(greatest(classical, majority) - method, 6) AS regret FROM w) SELECT domain, count(*) AS n, round(avg(regret), 5) AS mean, round(median(regret), 5) AS median, max(regret) AS worst, count(*) FILTER (WHERE regret <= 0) AS n_at_least, count(*) FILTER (WHERE regret <= 0.05) AS n_within, count(*) FILTER (WHERE regret > 0.1) AS n_worse FROM r GROUP BY domain")
def regret_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = scores(spark, sf_dir).groupBy("dataset", "domain").pivot("method", ["classical", "majority", "method"]).agg(F.avg("score"))
    rows = metrics.with_regret(wide).withColumn("regret", F.round("regret", 6))
    return metrics.regret_summary(rows, ("domain",)).withColumns({c: F.round(c, 5) for c in ("mean", "median")})


@query(f"{_WIDE} SELECT dataset, domain, round(classical, 6) AS classical, round(majority, 6) AS majority, round(method, 6) AS method, CAST(row_number() OVER (ORDER BY CASE domain WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 ELSE 3 END, lower(dataset)) - 1 AS INTEGER) AS at FROM w")
def sweep_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.sweep_table(scores(spark, sf_dir), ["classical", "majority", "method"], ["EUROPE", "ASIA"])
    return out.withColumns({c: r6(c) for c in ("classical", "majority", "method")})


@query(f"WITH s AS ({_SCORES}), m AS (SELECT dataset AS model, avg(score) AS score FROM s GROUP BY ALL) SELECT model, round(score, 6) AS score, score > 0.5 AS beats, CAST(row_number() OVER (ORDER BY score DESC, model) AS INTEGER) AS place FROM (SELECT model, round(score, 6) AS score FROM m)")
def capability_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = scores(spark, sf_dir).groupBy(F.col("dataset").alias("model")).agg(F.round(F.avg("score"), 6).alias("score"))
    return metrics.ladder(models, 0.5)


@query(f"""{_WIDE} SELECT dataset AS model, round(classical, 6) AS knowledge, round(majority, 6) AS anon, round(method, 6) AS fusion, round(method - greatest(classical, majority), 6) AS gap, method - greatest(classical, majority) > 0 AS wins,
CASE WHEN classical >= 0.85 THEN 'high' WHEN classical >= 0.65 THEN 'moderate' ELSE 'low' END AS memorisation FROM w""")
def fusion_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    arm = F.create_map(F.lit("classical"), F.lit("knowledge"), F.lit("majority"), F.lit("anon"), F.lit("method"), F.lit("fusion"))
    rows = scores(spark, sf_dir).select(F.col("dataset").alias("model"), arm[F.col("method")].alias("condition"), "score")
    return metrics.fusion_gap(rows).withColumns({c: r6(c) for c in ("knowledge", "anon", "fusion", "gap")})


@query("""WITH s AS (SELECT c_nationkey AS nation, round(c_acctbal / 500, 0) AS score, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS y FROM customer),
p AS (SELECT a.nation, avg(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc FROM s a JOIN s b ON a.nation = b.nation AND a.y = 1 AND b.y = 0 GROUP BY a.nation)
SELECT n.nation, round(auc, 6) AS auc FROM (SELECT DISTINCT nation FROM s) n LEFT JOIN p ON n.nation = p.nation""")
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = testdata.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.round(F.col("c_acctbal") / 500, 0).alias("score"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("label"))
    return metrics.roc_auc(c, ("nation",)).withColumn("auc", r6("auc"))


# -- collections, text, prompts, learners ------------------------------------------


@query(f"WITH {G1} SELECT g AS graph_id FROM (SELECT * FROM N ORDER BY g LIMIT 4000) WHERE n >= 3 AND m >= 1")
def usable_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.usable(g1(spark, sf_dir))


@query(f"""WITH {G1}, L AS (SELECT DISTINCT c_custkey AS g, c_mktsegment AS label FROM customer JOIN orders ON o_custkey = c_custkey), F AS (SELECT N.* FROM N JOIN L ON N.g = L.g ORDER BY N.g LIMIT 100)
SELECT 'g1' AS name, 'retail' AS domain, CAST(sum(c) AS BIGINT) AS n, count(*) AS classes, (SELECT round(avg(n), 1) FROM F) AS "avgN", (SELECT round(avg(m), 1) FROM F) AS "avgE", true AS has_x,
(SELECT count(DISTINCT p_brand) + count(DISTINCT p_type) FROM part JOIN V ON V.p = p_partkey) AS ncat, round(max(c) / sum(c), 3) AS chance FROM (SELECT label, count(*) AS c FROM L GROUP BY label)""")
def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.profile(g1(spark, sf_dir, True), testdata.customers(spark, sf_dir), "g1", "retail")


@query("""SELECT c_custkey AS graph_id, CAST(4 AS BIGINT) AS n_nodes, CAST(3 AS BIGINT) AS n_edges, 'A' || c_nationkey AS val_a, '?' AS val_d FROM customer""")
def graph_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = testdata.table(spark, sf_dir, "customer")
    attrs = F.concat(F.lit("a:x, a: A"), F.col("c_nationkey").cast("string"), F.lit(" ;zz:1,b"))
    gs = text.graphs_from_text(c.select(F.col("c_custkey").alias("graph_id"), F.lit("a-b, b c;\n c - d, oops, b-a").alias("edges_text"), attrs.alias("attrs_text")))
    val = lambda n: F.max(F.when(F.col("node_id") == n, F.col("attrs")["group"])).alias(f"val_{n}")
    return S.size(gs).drop("density").join(gs.vertices.groupBy("graph_id").agg(val("a"), val("d")), "graph_id")


@query(f"""WITH {G1}, one AS (SELECT 1)
SELECT CAST(g AS VARCHAR) AS run, concat_ws(chr(10), 'Task', '', '=== LABELED EXAMPLES ===', '[CLASS1]' || chr(10) || 'n' || n || chr(10), '=== QUERIES (classify each) ===', 'Query 0:' || chr(10) || 'm' || m || chr(10)) AS prompt FROM N""")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S.size(g1(spark, sf_dir)).withColumn("run", F.col("graph_id").cast("string"))
    shot = n.select("run", F.lit("shot").alias("role"), F.lit(0).alias("ord"), prompts.class_token(F.lit(1)).alias("token"), F.concat(F.lit("n"), F.col("n_nodes").cast("string")).alias("body"))
    ask = n.select("run", F.lit("query").alias("role"), F.lit(0).alias("ord"), prompts.class_token(F.lit(0)).alias("token"), F.concat(F.lit("m"), F.col("n_edges").cast("string")).alias("body"))
    return prompts.prompts(F.lit("Task"), shot.unionByName(ask))


@query("SELECT c_mktsegment AS label FROM customer JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o_custkey = c_custkey GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def majority_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.majority(testdata.customers(spark, sf_dir))


@query()
def logistic_on_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few-shot classification of the segments on the feature vectors of groups B and C."""
    split = splits.few_shot(testdata.customers(spark, sf_dir), [11], 5)
    gs = g1(spark, sf_dir).only(split.select(F.col("id").alias("graph_id")))
    x = facts_.structure(gs, "BC").select(F.col("graph_id").alias("id"), feature_column("BC").alias("features"))
    rows = split.join(x, "id").cache()
    out = learners.logistic(rows.filter("role = 'shot'"), rows.filter("role = 'query'"), rounds=200)
    return out.select("id", "label", "prediction", r6("probability").alias("probability"))


# -- alignments, molecules, baselines and generators -------------------------------

_BITS = "coalesce(array_to_string(list_transform(embedding[1:6], lambda v: CASE WHEN v > 0 THEN '1' ELSE '0' END), ','), '')"


@query(f"""WITH K AS (SELECT vec_id AS id, {_BITS} AS key FROM embeddings), A AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS n FROM K),
B AS (SELECT -id AS id, key, row_number() OVER (PARTITION BY key ORDER BY -id) AS n, count(*) OVER (PARTITION BY key) AS many FROM K)
SELECT A.id AS left_id, B.id AS right_id, many = 1 AS "unique" FROM A JOIN B ON A.key = B.key AND A.n = B.n""")
def aligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = testdata.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 6).alias("x"))
    return collections.aligned_by_rows(x, x.withColumn("id", -F.col("id")))


@query("""WITH P AS (SELECT p_type AS label, p_name AS text, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS n, count(*) OVER (PARTITION BY p_type) AS size FROM part WHERE p_type <> 'PROMO')
SELECT p_partkey AS id, p_type AS label, coalesce(P.text, '(no text; class ' || p_type || ')') AS text FROM part LEFT JOIN P ON P.label = p_type AND P.n = p_partkey % P.size""")
def class_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = testdata.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("label"), F.col("p_name").alias("text"))
    return collections.aligned_by_class(parts.select("id", "label"), parts.filter("label <> 'PROMO'"))


@query("""SELECT vec_id AS graph_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 4) AS total FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0""")
def embedding_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = testdata.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("graph_id"), F.col("embedding").cast("array<double>").alias("features"))
    kept = rows.filter(F.col("features").isNotNull() & ~F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
    return collections.embeddings(rows, kept).select("graph_id", F.size("features").alias("n"), F.round(total, 4).alias("total"))


_SYMBOL = "CASE z " + " ".join(f"WHEN {z} THEN '{s}'" for z, s in collections.SYMBOLS.items()) + " ELSE 'Z' || z END"


@query(f"""WITH X AS (SELECT g, s, count(*) AS n, min(o) AS o FROM (SELECT l_orderkey AS g, l_linenumber AS o, {_SYMBOL} AS s FROM (SELECT *, l_partkey % 60 AS z FROM lineitem)) GROUP BY ALL)
SELECT g AS graph_id, 'Atoms (' || CAST(sum(n) AS BIGINT) || ' total): ' || string_agg(s || 'x' || n, ', ' ORDER BY n DESC, o, s || 'x' || n) AS text FROM X GROUP BY g""")
def element_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = testdata.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("node_ord"), (F.col("l_partkey") % 60).alias("number"))
    return collections.element_lines(atoms)


@query(f"WITH {G1} SELECT g AS graph_id, v AS node_id, least(d, 50) AS at, 51 AS width FROM D")
def degree_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = learners.degree_one_hot(g1(spark, sf_dir).degrees)
    return hot.select("graph_id", "node_id", (F.array_position("features", F.lit(1.0)) - 1).alias("at"), F.size("features").alias("width"))


def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regression split with a customer's balance as value."""
    value = testdata.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    return splits.regression_split(testdata.customers(spark, sf_dir), 11, 10, 12).join(value, "id")


@query(f"""WITH {_SEGMENTS}, X AS (SELECT id, row_number() OVER (ORDER BY {sql_digest('11', 'id')}, id) - 1 AS ord FROM C),
M AS (SELECT round(avg(c_acctbal), 4) AS prediction FROM X JOIN customer ON c_custkey = id WHERE ord < 10 OR (ord >= 22 AND ord < 412))
SELECT id, prediction FROM X, M WHERE ord >= 10 AND ord < 22""")
def mean_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _balances(spark, sf_dir)
    out = learners.mean_value(rows.filter("role = 'train'"), rows.filter("role = 'query'").drop("value"))
    return out.select("id", F.round("prediction", 4).alias("prediction"))


@query()
def ridge_on_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge regression of the balances on the feature vectors of groups B and C."""
    rows = _balances(spark, sf_dir)
    gs = testdata.packed_purchases(spark, sf_dir, ids=rows.select(F.col("id").alias("graph_id")).distinct())
    x = facts_.structure(gs, "BC").select(F.col("graph_id").alias("id"), feature_column("BC").alias("features"))
    rows = durable(rows.join(x, "id"))
    out = learners.ridge(rows.filter("role = 'train'"), rows.filter("role = 'query'"))
    return out.select("id", r6("prediction").alias("prediction"))


@query(f"WITH {KG} SELECT h, r, t FROM K UNION ALL SELECT t, r || '^-1', h FROM K")
def kg_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg.both_ways(testdata.knowledge(spark, sf_dir))


@query(f"""WITH {KG}, n AS (SELECT count(*) AS n FROM ent), m AS (SELECT count(*) AS m FROM (SELECT DISTINCT least(h, t), greatest(h, t) FROM K WHERE h <> t))
SELECT CAST(0 AS BIGINT) AS graph_id, n AS n_nodes, m AS n_edges FROM n, m""")
def kg_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.size(neighborhoods.skeleton(testdata.knowledge(spark, sf_dir))).drop("density")


@query(f"WITH {KG} SELECT e AS ent, count(*) AS n FROM (SELECT h AS e FROM K UNION ALL SELECT t FROM K WHERE t <> h) GROUP BY e")
def kg_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighborhoods.incident(testdata.knowledge(spark, sf_dir)).groupBy("ent").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS run FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)")
def pending_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = testdata.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("run"))
    line = F.when(F.col("o_orderkey") % 2 == 1, "0: CLASS1").otherwise(" ")
    return prompts.pending(runs, testdata.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("run"), line.alias("line")))


@query(f"""WITH RECURSIVE {G1}{_TOP}{_HOPS.format(seeds="T.r = 1", place="near.d", join="", cap=25)}
SELECT g AS seed_id, v AS node_id, 'A' || lpad(CAST(i AS VARCHAR), 2, '0') AS token FROM pick""")
def anonymous_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    gs = g1(spark, sf_dir).stored()
    _, members = neighborhoods.ego_graphs(gs, targets(gs).withColumn("seed_id", F.col("graph_id")))
    return neighborhoods.anonymous(members)


@query()
def link_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    def beyond(gs: GraphSet) -> DataFrame:
        gs = gs.stored()
        return links.link_features(gs, top_pairs(gs))

    return links.link_lines(packed.each(p1(spark, sf_dir), packed.top_link(False), packed.LINK, beyond))


@query()
def synthetic_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of random, preferential and small-world graphs, 16 of each."""
    gs, labels = builtin.families(spark, 11, 16)
    return S.size(gs).join(labels, "graph_id").withColumn("density", r6("density"))


@query()
def block_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of a stochastic block model, with the block of each node."""
    gs = builtin.blocks(spark, 11)
    block = gs.vertices.select("graph_id", "node_id", F.col("attrs")["block"].alias("block"))
    return gs.degrees.join(block, ["graph_id", "node_id"]).select("graph_id", "node_id", "block", "deg")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
