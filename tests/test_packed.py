"""Many rows of a hub, a graph or a relation; graphs as rows: the same results where some graphs are too large for a row, and no edge in a shuffle or a join."""

import math

import pytest

from knotwork import queries as graph
from knotwork.operators import kg, neighborhoods
from knotwork.sources import testdata
from knotwork.sources.testdata import packed_purchases

#: Findings F1 to F6, F9, F10, F15, F16 and F18 to F28 but for knowledge graphs.
PACKED = [
    "all_facts", "distances_by_frontier", "feature_vector_all", "negative_pairs", "node_text", "verbalize", "null_models", "link_features", "link_lines", "community_purity", "triangles_clustering", "local_clustering",
    "joint_neighborhood", "ego_graph", "modularity_of_types", "component_of_node", "degree_assortativity", "observed_edges", "cross_edges", "edge_text"]


def plain(v):
    return (None if math.isnan(v) else round(v, 5) + 0.0) if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, list) else v


def rows(df):
    return sorted(([plain(v) for v in r] for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", PACKED)
def test_graphs_beyond_a_row_come_out_the_same(spark, sf, tmp_path, monkeypatch, name):
    few = spark.range(0, 150, 12).select("id")
    for t in ("lineitem", "part", "customer"):
        testdata.table(spark, sf, t).write.parquet(f"{tmp_path}/{t}.parquet")
    testdata.table(spark, sf, "orders").join(few.withColumnRenamed("id", "o_custkey"), "o_custkey", "left_semi").write.parquet(f"{tmp_path}/orders.parquet")
    whole = rows(graph.queries()[name](spark, str(tmp_path)))
    made = []

    def small(session, folder, attr=None, ids=None):
        made.append(packed_purchases(session, folder, attr, ids, most=40))
        return made[-1]

    monkeypatch.setattr(testdata, "packed_purchases", small)
    assert rows(graph.queries()[name](spark, str(tmp_path))) == whole and whole
    beyond = made[0].beyond.vertices.select("graph_id").distinct().count()
    assert 0 < beyond < few.count()


@pytest.mark.parametrize("name", [*PACKED, "ridge_on_facts"])
def test_no_edges_are_shuffled(spark, sf, name):
    steps = graph.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # The one exchange gathers orders; before, edges and degrees were joined, up to 30 times.
    most = 1 if name == "ridge_on_facts" else 0
    assert steps.count("Join") <= most and steps.count("Aggregate") <= 1


def test_contexts_of_a_hub(spark, tmp_path):
    hub = [(f"c{i:03}", "from", "n") for i in range(200)] + [("n", f"r{i:02}", "c007") for i in range(30)] + [("n", "in", "n"), ("c003", "from", "n"), ("a", "x", "b")]
    triples = spark.createDataFrame(hub, "h string, r string, t string")
    queries = triples.distinct().rdd.zipWithIndex().map(lambda x: (x[1], *x[0])).toDF("qid long, h string, r string, t string")
    for cap, head_only in ((24, False), (3, False), (24, True)):
        got = rows(neighborhoods.typed_context(triples, queries, cap, head_only))
        assert got == rows(neighborhoods.whole_context(triples, queries, cap, head_only)) and len(got) == 232
    # Each of 201 queries met all 232 triples at the hub before.
    plan = neighborhoods.typed_context(triples.filter("r = 'from'"), queries.filter("r = 'from'"))
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_parts_spread_with_the_input(spark, sf):
    before = rows(testdata.part_pairs(spark, sf, 1).edges)
    gs = testdata.part_pairs(spark, sf, 1, lines=500)
    plan = gs.edges._jdf.queryExecution().optimizedPlan().toString()
    # 6,000 lines: 12 partitions of orders and of pairs, where there were the session's 4.
    assert plan.count(", 12") >= 3 and rows(gs.edges) == before


@pytest.mark.parametrize("n", [0, 12])
def test_answers_are_ranked_a_head_at_a_time(spark, n):
    train = [("a", "r", "x"), ("b", "r", "x"), ("c", "r", "x"), ("a", "r", "y"), ("b", "r", "y"), ("c", "r", "z"), ("x", "s", "w"), ("a", "r", "y")]
    # Known of the same head: x, y (twice), z and v, which training knows as a head alone; "new" it never saw.
    test = [("a", "r", "z"), ("a", "r", "z"), ("a", "r", "v"), ("a", "r", "new"), ("d", "r", "w"), (None, "r", "z"), ("e", "s", "x")]
    all_ = [(*x, "train") for x in [*train, ("v", "s", "w")]] + [(*x, "test") for x in test] + [("d", "r", "x", "valid"), (None, "r", "x", "valid")]
    triples = spark.createDataFrame(all_, "h string, r string, t string, split string")
    learnt = [x for x in all_ if x[3] == "train"]
    ents = {x[0] for x in learnt} | {x[2] for x in learnt}
    count = lambda e, r=None: sum(x[2] == e and r in (None, x[1]) for x in learnt)
    place = {(r, e): i for r in "rs" for i, e in enumerate(sorted(ents, key=lambda e: (-count(e, r), -count(e), e)), 1)}
    want = []
    for h, r, t in test:
        mine = place.get((r, t))
        others = {x[2] for x in all_ if h is not None and x[:2] == (h, r) and x[2] != t}
        want.append([h, r, t, mine and mine - sum(place.get((r, o), 99) < mine for o in others)])
    got = kg.frequency_ranks(triples, n)
    assert rows(got) == sorted(want, key=repr)
    # Before, each test met all known tails of its head, in as many partitions as the session has.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and (plan.count(", 12") >= 3 or not n)


def test_triples_spread_with_the_input(spark, sf, monkeypatch):
    names = ("kg_triples", "kg_top_tails", "kg_ranking_scores")
    before = [rows(graph.queries()[k](spark, sf)) for k in names]
    parts = testdata.knowledge_parts
    monkeypatch.setattr(testdata, "knowledge_parts", lambda s, d: parts(s, d, 500))
    assert testdata.knowledge(spark, sf)._jdf.queryExecution().optimizedPlan().toString().count(", 12") >= 1
    assert [rows(graph.queries()[k](spark, sf)) for k in names] == before


def test_prose_tells_of_every_node(spark, sf):
    """before, the prose of packed graphs had neither key nodes nor a line a node."""
    said = {r.graph_id: r.text for r in graph.verbalize(spark, sf).collect()}
    nodes = {}
    for r in graph.local_clustering(spark, sf).collect():
        nodes.setdefault(r.graph_id, {})[r.node_id] = r.deg
    assert set(said) == set(nodes)
    for g, deg in nodes.items():
        lines = said[g].split("\n")
        told = {x.split(":")[0].strip(): int(x.split("degree ")[1].split(",")[0]) for x in lines if x.startswith("  ")}
        assert told == deg
        first = min(deg, key=lambda v: (-deg[v], v))
        assert sum(x.startswith(f"Key nodes: most connected {first} ({deg[first]})") for x in lines) == 1
