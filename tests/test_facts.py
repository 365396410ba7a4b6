import math

import numpy as np
import pytest
from graphs import bipartite, collection, complete, cycle, path, random_graph, star
from pyspark.sql import functions as F

from knotwork.facts import facts, structure
from knotwork.functions.render import verbalize, verbalize_nodes, ranked_nodes
from knotwork.model import Caps, GraphSet, undirect
from knotwork.operators import iterative, kernels
from knotwork.plans import structure as S
from knotwork.registry import feature_names, feature_vectors, registry_table
from knotwork.sources import builtin

OFFICE = {
    "n_nodes": 10, "n_edges": 14, "density": 0.311111, "n_components": 1, "mean_degree": 2.8, "max_degree": 4, "degree_std": 0.6, "max_over_mean_degree": 1.428571,
    "degree_skewness": 0.111111, "degree_kurtosis": -0.444444, "degree_gini": 0.107143, "powerlaw_alpha": 1.588620, "avg_clustering": 0.333333, "transitivity": 0.333333,
    "n_triangles": 3, "n_squares": 4, "avg_path_length": 2.377778, "diameter": 5, "radius": 3, "degree_assortativity": -0.014493, "n_communities": 2, "modularity": 0.426020,
    "max_kcore": 2, "spectral_gap": 0.235963, "n_cycles": 5, "betweenness_mean": 0.172222, "betweenness_max": 0.569444, "closeness_mean": 0.432877, "eigenvector_mean": 0.283810,
    "eigenvector_max": 0.506803, "er_clustering_ratio": 1.071429, "config_clustering": 0.132835, "config_clustering_ratio": 2.509374, "smallworld_sigma": 1.007699, "smallworld_omega": -0.059481,
}
MOLECULE = {
    "n_nodes": 9, "n_edges": 9, "density": 0.25, "mean_degree": 2.0, "degree_std": 0.666667, "degree_skewness": 0, "degree_kurtosis": -0.75, "degree_gini": 0.172840, "powerlaw_alpha": 1.756221,
    "avg_clustering": 0, "n_triangles": 0, "n_squares": 0, "avg_path_length": 2.444444, "diameter": 5, "radius": 3, "degree_assortativity": -0.40625, "n_communities": 3, "max_kcore": 2,
    "spectral_gap": 0.267949, "n_cycles": 1, "betweenness_mean": 0.206349, "betweenness_max": 0.607143, "closeness_mean": 0.421965, "eigenvector_mean": 0.317376, "eigenvector_max": 0.518379,
    "config_clustering": 0.082990, "smallworld_sigma": 0,
}


@pytest.fixture(scope="module")
def office(spark):
    return facts(builtin.office(spark), ["dept", "seniority", "absent"]).cache()


@pytest.fixture(scope="module")
def molecule(spark):
    return facts(builtin.molecule(spark), ["atom"]).cache()


def test_office(office):
    row = office.first()
    assert {k: round(float(v), 6) for k, v in row.structure.asDict().items()} == OFFICE
    assert row.ring_sizes == {3: 3, 4: 2}
    dept, seniority = row.attributes["dept"], row.attributes["seniority"]
    assert set(row.attributes) == {"dept", "seniority"}
    assert round(dept.assortativity, 5) == 0.85641 and dept.cross_edges == 1 and dept.community_purity == 1.0
    assert [(e.src, e.dst) for e in dept.cross_edge_list] == [("Alice", "Frank")]
    assert {k: round(v, 5) for k, v in dept.mean_betweenness_by_group.items()} == {"Eng": 0.15556, "Sales": 0.18889}
    assert round(seniority.assortativity, 5) == -0.45833 and seniority.cross_edges == 10 and round(seniority.community_purity, 6) == 0.6
    assert {k: round(v, 5) for k, v in seniority.mean_betweenness_by_group.items()} == {"jr": 0.08951, "snr": 0.29630}
    assert [x.node_id for x in row.nodes.top_degree] == ["Alice", "Bob", "Carol", "Dan", "Frank"]
    assert row.nodes.n_isolates == 0 and row.nodes.min_degree_node == "Eve"


def test_molecule(molecule):
    row = molecule.first()
    got = row.structure.asDict()
    assert {k: round(float(got[k]), 6) + 0.0 for k in MOLECULE} == MOLECULE
    assert math.isnan(got["smallworld_omega"]) and row.ring_sizes == {6: 1}
    assert round(got["modularity"], 6) in (0.314815, 0.327160)
    assert round(row.attributes["atom"].assortativity, 5) == 0.23944


def test_office_text(office):
    text = verbalize(office).first().text
    assert text == verbalize(office).first().text
    lines = text.split("\n")
    assert lines[0] == "Size & connectivity: 10 nodes, 14 edges, density 0.31, 1 connected component(s)."
    assert lines[4] == "Mixing & community: degree assortativity -0.01; 2 communities (modularity Q = 0.43)."
    assert "  Bob: degree 3, betweenness 0.10, eigenvector 0.41, community 0; neighbors: Alice, Carol, Eve" in lines
    assert "The 1 cross-dept tie runs through: Alice-Frank." in text and "central positions (1.2x" not in text
    assert "'snr' nodes sit in more central positions (3.3x the mean betweenness of 'jr')." in text
    assert "Ties are strongly homophilous on dept (assortativity 0.86)." in text
    only = verbalize(office, "structure", "AG").first().text
    assert only.split("\n")[1] == "Cycles: 5 independent cycles (cyclomatic number)." and len(only.split("\n")) == 2
    with pytest.raises(ValueError):
        verbalize(office, "everything")


def test_node_text(spark):
    gs = builtin.office(spark)
    rows = verbalize_nodes(ranked_nodes(S.local_clustering(gs)), kernels.node_facts(kernels.kernel_facts(gs)), S.neighbor_lists(gs))
    text = {r.node_id: r.text for r in rows.collect()}
    assert text["Alice"] == "Node 'Alice': degree 4 (rank 1 of 10), local clustering 0.33. Betweenness 0.565. Eigenvector centrality 0.507. Neighbors (4): Bob, Carol, Dan, Frank."
    assert "(rank 2 of 10)" in text["Bob"]


def test_attrs_must_be_a_list(spark):
    with pytest.raises(TypeError):
        facts(builtin.office(spark), "dept")


@pytest.fixture(scope="module")
def closed(spark):
    graphs = {1: (1, []), 2: (4, []), 3: complete(5), 4: cycle(6), 5: star(6), 6: bipartite(2, 3), 7: (8, complete(4)[1] + [(a + 4, b + 4) for a, b in complete(4)[1]]), 8: path(4)}
    return {r.graph_id: r for r in facts(collection(spark, graphs), nodes=False).collect()}


def test_closed_forms(closed):
    s = {g: r.structure for g, r in closed.items()}
    nan = math.isnan
    assert (s[1].density, s[1].avg_path_length, s[1].diameter, s[1].closeness_mean, s[1].n_communities) == (0, 0, 0, 0, 1)
    assert (s[2].n_components, s[2].n_communities, s[2].modularity, s[2].eigenvector_max, s[2].max_kcore) == (4, 4, 0, 0, 0) and nan(s[2].degree_assortativity) and nan(s[2].powerlaw_alpha)
    assert (s[3].avg_clustering, s[3].avg_path_length, s[3].n_triangles, s[3].n_squares) == (1, 1, 10, 15) and round(s[3].spectral_gap, 9) == 5 and nan(s[3].degree_assortativity)
    assert (s[4].n_cycles, s[4].avg_clustering, s[4].degree_skewness, s[4].degree_kurtosis, s[4].diameter) == (1, 0, 0, 0, 3)
    assert round(s[5].degree_assortativity, 9) == -1 and s[5].betweenness_max == 1 and s[5].n_cycles == 0
    assert (s[6].n_squares, s[6].n_triangles) == (3, 0)
    assert s[7].n_components == 2 and s[7].avg_path_length == 1 and s[7].n_communities == 2
    assert (s[8].diameter, s[8].radius) == (3, 2)
    assert closed[1].ring_sizes == {} and closed[4].ring_sizes == {6: 1} and closed[6].ring_sizes == {4: 2}


def test_caps(spark):
    gs = collection(spark, {1: path(5), 2: path(6)})
    gs = GraphSet(gs.vertices, gs.edges, Caps(squares=5, paths=5, per_node=5))
    rows = {r.graph_id: r for r in facts(gs).collect()}
    assert rows[1].structure.n_squares == 0 and rows[2].structure.n_squares is None
    assert rows[1].structure.avg_path_length == 2 and rows[2].structure.avg_path_length is None
    assert len(rows[1].nodes.per_node) == 5 and rows[2].nodes.per_node is None


def scanned_communities(n, edges):
    """Merge the linked pair of largest gain by looking at all pairs each time."""
    parts = [[v] for v in range(n)]
    while True:
        best = None
        for i, a in enumerate(parts):
            for b in parts[i + 1 :]:
                between = sum((u in a and v in b) or (u in b and v in a) for u, v in edges)
                deg = [sum((u in c) + (v in c) for u, v in edges) for c in (a, b)]
                if between and (gain := 2 * len(edges) * between - deg[0] * deg[1]) >= 0 and (best is None or gain > best[0]):
                    best = gain, a, b
        if best is None:
            return sorted(parts, key=lambda c: (-len(c), c[0]))
        _, a, b = best
        parts = sorted([c for c in parts if c is not a and c is not b] + [sorted(a + b)])


def test_communities_against_scan():
    for seed in range(12):
        n, edges = random_graph(seed, 6 + seed, 0.15 + 0.05 * (seed % 4))
        assert kernels.communities(n, np.array(edges, int).reshape(-1, 2)) == scanned_communities(n, edges)
    assert kernels.communities(3, np.empty((0, 2), int)) == [[0], [1], [2]]


def test_communities_of_large_graphs(spark):
    graphs = {1: random_graph(1, 12, 0.3), 2: random_graph(2, 30, 0.15), 3: random_graph(3, 60, 0.1)}
    gs = collection(spark, graphs)
    whole = {r.graph_id: r for r in structure(gs, "E").collect()}
    cut = GraphSet(gs.vertices, gs.edges, Caps(dense=12, merged=30))
    rows = {r.graph_id: r for r in structure(cut, "E").collect()}
    for g in (1, 2):
        assert (rows[g].n_communities, rows[g].modularity) == (whole[g].n_communities, whole[g].modularity)
    assert rows[3].n_communities is None
    of = {r.graph_id: r.of for r in kernels.large_communities(cut).collect()}
    assert set(of) == {2} and len(of[2]) == 30 and max(of[2]) + 1 == whole[2].n_communities


def test_graphs_beyond_the_dense_kernel_keep_their_rows(spark):
    gs = collection(spark, {1: random_graph(1, 10, 0.3), 2: random_graph(2, 24, 0.12), 3: (14, path(9)[1])})
    cut = GraphSet(gs.vertices, gs.edges, Caps(dense=12))
    want, got = ({r.graph_id: r for r in kernels.kernel_facts(x).collect()} for x in (gs, cut))
    assert set(got) == {1, 2, 3} and got[1] == want[1]
    for g in (2, 3):
        a, b = want[g], got[g]
        for c in ("n_components", "lcc_size", "diameter", "radius", "n_communities", "max_kcore"):
            assert a[c] == b[c], (g, c)
        for c in ("avg_path_length", "modularity", "betweenness_mean", "betweenness_max", "closeness_mean"):
            assert abs(a[c] - b[c]) < 1e-9, (g, c)
        assert abs(a.eigenvector_max - b.eigenvector_max) < 1e-2 and len(a.nodes) == len(b.nodes)
        assert abs(a.spectral_gap - b.spectral_gap) < 1e-9 and a.eig_degenerate == b.eig_degenerate
        for x, y in zip(a.nodes, b.nodes, strict=True):
            assert (x.node_id, x.node_ord, x.component, x.community, x.core) == (y.node_id, y.node_ord, y.component, y.community, y.core)
            assert abs(x.betweenness - y.betweenness) < 1e-9 and abs(x.closeness - y.closeness) < 1e-9
    assert got[3].ring_sizes == {}
    assert kernels.node_facts(kernels.kernel_facts(cut)).count() == 48


def test_graphs_beyond_one_task_go_by_rounds(spark):
    gs = collection(spark, {1: random_graph(1, 10, 0.3), 2: random_graph(2, 24, 0.12), 3: random_graph(3, 16, 0.3)})
    want, got = ({r.graph_id: r for r in kernels.kernel_facts(x).collect()} for x in (gs, GraphSet(gs.vertices, gs.edges, Caps(dense=12, merged=20))))
    for g in (1, 2, 3):
        assert [x.core for x in want[g].nodes] == [x.core for x in got[g].nodes]
        assert abs(want[g].eigenvector_max - got[g].eigenvector_max) < 1e-2
    assert got[2].spectral_gap is None and abs(got[3].spectral_gap - want[3].spectral_gap) < 1e-9


@pytest.mark.parametrize("dense", [1, 4])
@pytest.mark.parametrize("graph", [random_graph(s, 12 + s, 0.04 + 0.02 * s) for s in range(8)] + [path(40), cycle(31), complete(9), (7, []), (6, [(0, 1), (2, 3)])])
def test_spectrum_and_cores_without_a_dense_matrix(graph, dense):
    n, edges = graph[0], np.array(sorted(tuple(sorted(e)) for e in graph[1]), int).reshape(-1, 2)
    a = kernels.adjacency(n, edges)
    low = kernels.labels(n, edges)
    assert (low == kernels.components(kernels.distances(a)[0])).all()
    x, degenerate, gap = kernels.large_spectrum(n, edges, low, dense)
    want, ties = kernels.eigenvector(a)
    lcc = low == np.bincount(low, minlength=n).argmax()
    assert degenerate == ties and abs(gap - kernels.spectral_gap(a[np.ix_(lcc, lcc)])) < 1e-7
    assert ties or np.abs(x - want).max() < 1e-6
    assert (kernels.peeled(n, edges) == kernels.core_numbers(a)).all()


def test_moments_are_exact_or_in_floating_point(spark):
    big = spark.createDataFrame([(1, 0, 3 * 10**9), (1, 1, 1), (1, 2, 1), (2, 0, 2), (2, 1, 1), (2, 2, 1)], "graph_id long, node_ord int, deg long").withColumn("node_id", F.col("node_ord").cast("string"))
    rows = {r.graph_id: r for r in S.degree_moments(GraphSet(None, None, known_degrees=big)).collect()}
    for g in (1, 2):
        assert abs(rows[g].degree_skewness - 0.5**0.5) < 1e-6 and abs(rows[g].degree_kurtosis + 1.5) < 1e-6


def test_feature_vector_replaces_null_and_nan(spark):
    gs = collection(spark, {2: (4, []), 3: complete(5)})
    rows = {r.graph_id: r.features for r in feature_vectors(structure(gs)).collect()}
    assert len(rows[2]) == len(feature_names()) == 35 and rows[2][feature_names().index("powerlaw_alpha")] == 0.0
    assert all(x == x for v in rows.values() for x in v)
    assert registry_table(spark).count() == 35


@pytest.fixture(scope="module")
def many(spark):
    return collection(spark, {i: random_graph(i, 10 + i, 0.12 + 0.03 * (i % 5)) for i in range(6)})


def test_iterative_operators_agree_with_kernels(spark, many):
    nodes = {(r.graph_id, r.node_id): r for r in kernels.node_facts(kernels.kernel_facts(many)).collect()}
    dist = iterative.distances(many).cache()
    for r in iterative.betweenness(many, dist).collect():
        assert abs(r.betweenness - nodes[r.graph_id, r.node_id].betweenness) < 1e-9
    for r in iterative.closeness(many, dist).collect():
        assert abs(r.closeness - nodes[r.graph_id, r.node_id].closeness) < 1e-9
    for r in iterative.core_numbers(many).collect():
        assert r.core == nodes[r.graph_id, r.node_id].core
    parts = {}
    for r in iterative.components(many).collect():
        parts.setdefault((r.graph_id, r.component), set()).add(nodes[r.graph_id, r.node_id].component)
    assert all(len(v) == 1 for v in parts.values()) and len(parts) == len({(g, n.component) for (g, _), n in nodes.items()})
    kernel = {r.graph_id: r for r in kernels.kernel_facts(many).collect()}
    for r in iterative.path_facts(many, dist).collect():
        assert (round(r.avg_path_length, 9), r.diameter) == (round(kernel[r.graph_id].avg_path_length, 9), kernel[r.graph_id].diameter)


def test_power_iteration(spark):
    gs = collection(spark, {1: (6, path(6)[1] + [(0, 2)]), 2: (3, [])})
    want = {(r.graph_id, r.node_id): r.eigenvector for r in kernels.node_facts(kernels.kernel_facts(gs)).collect()}
    for r in iterative.eigenvector(gs, rounds=60, tolerance=1e-5).collect():
        assert abs(r.eigenvector - want[r.graph_id, r.node_id]) < 1e-3


def test_relational_facts_against_numpy(spark, many):
    tri = {}
    for r in S.local_clustering(many).collect():
        tri[r.graph_id] = tri.get(r.graph_id, 0) + r.triangles
    squares = {r.graph_id: r.n_squares for r in S.four_cycles(many).collect()}
    for i in range(6):
        n, e = random_graph(i, 10 + i, 0.12 + 0.03 * (i % 5))
        a = kernels.adjacency(n, np.array(e).reshape(-1, 2))
        d = a.sum(1)
        assert tri[i] == round(np.trace(a @ a @ a) / 2)
        assert squares[i] == round((np.trace(a @ a @ a @ a) - 2 * (d**2).sum() + 2 * len(e)) / 8)


def test_relabelling_keeps_facts(spark):
    from knotwork.operators.neighborhoods import permuted

    gs = builtin.molecule(spark)
    names = ["n_edges", "n_squares", "diameter", "degree_assortativity", "spectral_gap", "betweenness_max"]
    a, b = (structure(x).select(names).first() for x in (gs, permuted(gs, 4)))
    assert all(abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True))


def test_undirect(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "a", "a"), (1, "b", "c")], "graph_id long, src string, dst string")
    assert sorted((r.src, r.dst) for r in undirect(e).collect()) == [("a", "b"), ("b", "c")]


def test_facts_do_not_depend_on_a_size(spark):
    """before, squares and exact betweenness ended at 400 nodes, path lengths at 1,500, communities at 100,000."""
    sizes = {1: 420, 2: 1600, 3: 2100}  # the last is beyond the dense kernel
    gs = collection(spark, {g: star(n) for g, n in sizes.items()} | {4: bipartite(2, 410)})
    rows = {r.graph_id: r for r in structure(gs, "CDHJ", parts=frozenset({"betweenness", "closeness"})).collect()}
    for g, n in sizes.items():
        r = rows[g]
        assert (r.diameter, r.radius, r.n_squares) == (2, 1, 0) and abs(r.avg_path_length - (2 - 2 / n)) < 1e-9 and r.smallworld_sigma == 0
        assert abs(r.betweenness_mean - 1 / n) < 1e-12 and abs(r.betweenness_max - 1) < 1e-9
        assert abs(r.closeness_mean - (1 + (n - 1) ** 2 / (2 * n - 3)) / n) < 1e-9
    assert rows[4].n_squares == 410 * 409 // 2 and rows[4].betweenness_max == pytest.approx(410 * 409 / 2 / (411 * 410 / 2) / 2)
    caps = Caps()
    assert min(caps.squares, caps.paths, caps.exact_betweenness, caps.per_node, caps.merged) > 10**12
