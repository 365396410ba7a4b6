import pytest
from graphs import collection, complete, path, random_graph
from pyspark.sql import functions as F

from knotwork.operators import answers, kg, learners, links, metrics, neighborhoods, prompts, splits
from knotwork.sources import builtin, collections
from knotwork.sources import kg as kg_files
from knotwork.sources import sinks, text


def lines(spark, rows):
    return spark.createDataFrame([("r", "m", i, x) for i, x in enumerate(rows)], "run string, model string, line_no int, line string")


def test_class_answers(spark):
    for x in ("0 CLASS1", "Query 0 CLASS1", "0: class1", "0) CLASS1", "0 - CLASS1".replace("0 -", "0-")):
        assert [(r.qid, r.token) for r in answers.parse_classes(lines(spark, [x])).collect()] == [(0, "CLASS1")], x
    got = answers.parse_classes(lines(spark, ["0 CLASS1 because", "CLASS1", "0 A", "0 B", "", None]))
    assert [(r.qid, r.token) for r in got.collect()] == [(0, "B")]


def test_number_and_ranked_answers(spark):
    got = answers.parse_numbers(lines(spark, ["0 -0.73", "1: z=-0.73", "2 - -0.73", "3) 1.2 kcal/mol", "4 −2e1", "x 5", "6 none"]))
    assert sorted((r.qid, r.value) for r in got.collect()) == [(0, -0.73), (1, -0.73), (2, -0.73), (3, 1.2), (4, -20.0)]
    got = answers.parse_rankings(lines(spark, ["0) E007, e003 E007", "nothing"]))
    assert [(r.qid, r.ranked) for r in got.collect()] == [(0, ["E007", "E003"])]


def test_scores(spark):
    truth = spark.createDataFrame([("r", 0, "a"), ("r", 1, "a"), ("r", 2, "b"), ("s", 0, "a")], "run string, qid int, label string")
    given = spark.createDataFrame([("r", 0, "A"), ("r", 2, "A")], "run string, qid int, token string")
    assert {r.run: r.balanced_accuracy for r in metrics.balanced_accuracy(truth, given).collect()} == {"r": 0.25, "s": 0.0}
    assert {r.run: r.accuracy for r in metrics.raw_accuracy(truth, given).collect()} == {"r": 1 / 3, "s": None}
    auc = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.9, 1)], "score double, label int")
    assert metrics.roc_auc(auc).first().auc == 0.875
    scored = spark.createDataFrame([(0, "x", 1), (0, "y", 2), (0, "z", 3), (1, "x", 1)], "qid int, ent string, place int")
    true = spark.createDataFrame([(0, "z"), (1, "w")], "qid int, ent string")
    known = spark.createDataFrame([(0, "x"), (0, "z")], "qid int, ent string")
    assert sorted((r.qid, r["rank"]) for r in metrics.filtered_ranks(scored, true, known).collect()) == [(0, 2), (1, None)]


def test_pairs_and_neighbourhoods(spark):
    gs = collection(spark, {1: path(5)})
    pairs = spark.createDataFrame([(1, "0", "2"), (1, "0", "4")], "graph_id long, u string, v string")
    got = {(r.u, r.v): r for r in links.link_features(gs, pairs).collect()}
    assert (got["0", "2"].common_neighbors, got["0", "2"].jaccard, got["0", "2"].resource_allocation, got["0", "2"].shortest_path) == (1, 0.5, 0.5, 2)
    assert got["0", "4"].shortest_path == 4 and got["0", "4"].adamic_adar == 0
    cut = neighborhoods.observed(gs, spark.createDataFrame([(1, "3", "2")], "graph_id long, u string, v string"))
    assert links.link_features(cut, pairs).filter("v = '4'").first().shortest_path == -1
    line = links.link_lines(links.link_features(gs, pairs)).filter("v = '2'").first().text
    assert line.startswith("Link features (computed on the observed graph, excluding this pair): common-neighbors=1, Jaccard=0.500, Adamic-Adar=1.443")
    target = spark.createDataFrame([(7, 1, "2")], "seed_id long, graph_id long, node_id string")
    ego, members = neighborhoods.ego_graphs(gs, target, 2, 4)
    assert sorted((r.node_id, r.local) for r in members.collect()) == [("0", 3), ("1", 1), ("2", 0), ("3", 2)]
    assert ego.edges.count() == 3
    both, _ = neighborhoods.joint_graphs(gs, spark.createDataFrame([(7, 1, "1", "2")], "seed_id long, graph_id long, u string, v string"), 1, 9)
    assert sorted((r.src, r.dst) for r in both.edges.collect()) == [("0", "2"), ("1", "3")]
    assert neighborhoods.edge_text(gs).first().text == "edges: (0,1), (1,2), (2,3), (3,4)"
    names = neighborhoods.anonymous(members, spark.createDataFrame([(7, "zz")], "seed_id long, node_id string"))
    assert {r.node_id: r.token for r in names.collect()} == {"2": "A00", "1": "A01", "3": "A02", "0": "A03", "zz": "A04"}


def test_neighbour_votes(spark):
    gs = collection(spark, {1: (4, [(0, 1), (0, 2)])})
    labels = spark.createDataFrame([(1, "1", "b"), (1, "2", "a"), (1, "0", "b")], "graph_id long, node_id string, label string")
    got = {r.node_id: (r.counts, r.vote) for r in links.neighbour_labels(gs, labels, ["a", "b"]).collect()}
    assert got["0"] == ([1, 1], "a") and got["3"] == ([0, 0], "b")


def test_splits_do_not_depend_on_partitions(spark):
    items = spark.range(200).select(F.col("id").alias("graph_id"), (F.col("id") % 3).cast("string").alias("label"))
    want = None
    for n in (1, 4, 17):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted(map(tuple, splits.few_shot(items.repartition(n), [1, 2], 5, 20).collect()))
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    shots = [r for r in want if r[3] == "shot"]
    assert len(shots) == 2 * 3 * 5 and not {(s, i) for s, i, _, r, _ in want if r == "shot"} & {(s, i) for s, i, _, r, _ in want if r == "query"}
    gs = collection(spark, {1: random_graph(3, 30, 0.2)})
    pairs = splits.pair_split(gs, 5, 3, 8).collect()
    edges = {(r.src, r.dst) for r in gs.edges.collect()}
    assert all(((r.u, r.v) in edges) == r.linked for r in pairs) and sum(r.role == "query" for r in pairs) == 8
    assert splits.shots_per_class(5) == 5 and splits.shots_per_class(40) == 2


def test_kg(spark, tmp_path):
    (tmp_path / "train.txt").write_text("a\tlikes\tb\nbad line\nc\tlikes\tb\nc\tknows\ta\n")
    (tmp_path / "test.txt").write_text("b\tknows\tc\n")
    triples = kg_files.read_triples(spark, str(tmp_path))
    assert triples.count() == 4 and {r.split for r in triples.collect()} == {"train", "test"}
    assert [(r.value, r.id, r.token) for r in kg.entities(triples).orderBy("id").collect()] == [("a", 0, "E0"), ("b", 1, "E1"), ("c", 2, "E2")]
    assert [r.token for r in kg.relations(triples).orderBy("id").collect()] == ["R00", "R01"]
    queries = spark.createDataFrame([(0, "likes")], "qid int, r string")
    assert [r.ent for r in kg.frequency_tail_ranks(triples.filter("split = 'train'"), queries).orderBy("place").collect()] == ["b", "a", "c"]
    assert kg.commonest_relation(triples).first().r in ("knows", "likes") and kg.both_ways(triples).count() == 8
    coded = kg.encoded(triples, kg.entities(triples), kg.relations(triples)).select("hid", "rid", "tid").toPandas().to_numpy()
    ent, rel = kg.train_embedding(coded, 3, 2, 0, dim=8, epochs=200)
    e = kg.embedding_table(spark, ["a", "b", "c"], ent)
    r = kg.embedding_table(spark, ["knows", "likes"], rel)
    pairs = spark.createDataFrame([(0, "a", "likes", x) for x in "abc"], "qid int, h string, r string, t string")
    assert kg.ranked_by_score(kg.triple_scores(pairs, e, r), "t").filter("place = 1").first().t == "b"
    (tmp_path / "b.tsv").write_text("i\tn\tj\tm\nc1\tAsp\td1\tPain\nc2\tIbu\td1\tPain\n")
    edges, ent = kg_files.read_bipartite(spark, str(tmp_path / "b.tsv"))
    assert edges.count() == 2 and {(r.id, r.name, r.side) for r in ent.collect()} == {("c1", "Asp", "a"), ("c2", "Ibu", "a"), ("d1", "Pain", "b")}


def test_typed_context(spark):
    triples = spark.createDataFrame([("a", "r", "b"), ("a", "s", "c"), ("d", "r", "b"), ("b", "q", "a")], "h string, r string, t string")
    queries = spark.createDataFrame([(0, "a", "b"), (1, "x", "y")], "qid int, h string, t string")
    got = {r.qid: r.lines for r in neighborhoods.typed_context(triples, queries).collect()}
    assert got == {0: ["(a) -[s]-> (c)", "(d) -[r]-> (b)"], 1: []}
    assert neighborhoods.observed_triples(triples, queries.select("h", "t")).count() == 2


def test_learners(spark):
    rows = spark.createDataFrame([(i, [float(i), 5.0], "hi" if i > 4 else "lo", 2.0 * i + 1) for i in range(10)], "id int, features array<double>, label string, value double")
    got = {r.id: r.prediction for r in learners.logistic(rows, rows, rounds=100).collect()}
    assert got[0] == "lo" and got[9] == "hi"
    fit = {r.id: r.prediction for r in learners.ridge(rows, rows, alpha=1e-9).collect()}
    assert all(abs(fit[i] - (2 * i + 1)) < 1e-4 for i in range(10))
    assert learners.ridge(rows.filter("id = 3"), rows).first().prediction == 7.0
    assert learners.majority(rows).first().label == "hi" and learners.mean_value(rows, rows).first().prediction == 10.0
    one = learners.degree_one_hot(spark.createDataFrame([(1, 70)], "graph_id int, deg int")).first().features
    assert len(one) == 51 and one[50] == 1.0 and sum(one) == 1.0
    # A vector that projects to zero has no direction.
    assert all(abs(sum(x * x for x in r.features) - (r.id > 0)) < 1e-9 for r in learners.principal(rows, 1).collect())


def test_prompts(spark, tmp_path):
    items = spark.createDataFrame([("r", "shot", 0, "CLASS1", "x", 2.0), ("r", "query", 0, "CLASS0", "y", 3.0)], "run string, role string, ord int, token string, body string, value double")
    out = prompts.prompts(F.lit("Task"), items)
    assert out.first().prompt == "Task\n\n=== LABELED EXAMPLES ===\n[CLASS1]\nx\n\n=== QUERIES (classify each) ===\nQuery 0:\ny\n"
    assert [tuple(r) for r in prompts.truth(items).collect()] == [("r", 0, "CLASS0")]
    scale = prompts.target_scale(items).first()
    assert scale.zmean == 2.0 and abs(scale.zstd - 0.5) < 1e-6
    sinks.write_prompts(out, str(tmp_path / "p"))
    sinks.write_manifest(prompts.manifest(items), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().truth[0].label == "CLASS0"
    assert prompts.pending(items.select("run").distinct(), lines(spark, [" "])).count() == 1


def test_text_graphs(spark):
    rows = [(1, "0-1, 1 2;2-0\nx y z, -, 3-", "0:A, 1:B, 0:C, 9:D, bad"), (2, "a-b", None)]
    gs = text.graphs_from_text(spark.createDataFrame(rows, "graph_id long, edges_text string, attrs_text string"))
    assert sorted((r.graph_id, r.src, r.dst) for r in gs.edges.collect()) == [(1, "0", "1"), (1, "0", "2"), (1, "1", "2"), (2, "a", "b")]
    assert {(r.graph_id, r.node_id): r.attrs for r in gs.vertices.collect()}[1, "0"] == {"group": "C"}
    assert {(r.graph_id, r.node_id): r.attrs for r in gs.vertices.collect()}[1, "2"] == {"group": "?"}
    bad = text.graphs_from_text(spark.createDataFrame([(1, "nothing here at all", "")], "graph_id long, edges_text string, attrs_text string"))
    empty = text.graphs_from_text(spark.createDataFrame([(1, "a-b", None), (2, None, None)], "graph_id long, edges_text string, attrs_text string"))
    for rows in (bad.vertices, bad.edges, empty.vertices, empty.edges):
        for _ in range(3):
            with pytest.raises(Exception, match="no valid edges"):
                rows.collect()


def test_collections(spark, tmp_path):
    gs = collection(spark, {1: complete(3), 2: (2, [(0, 1)]), 3: (4, [])})
    assert [r.graph_id for r in collections.usable(gs).collect()] == [1]
    atoms = spark.createDataFrame([(1, "0", 0, 6), (1, "1", 1, 8), (1, "2", 2, 6), (1, "3", 3, 99)], "graph_id long, node_id string, node_ord int, number int")
    assert collections.element_lines(atoms).first().text == "Atoms (4 total): Cx2, Ox1, Z99x1"
    x = spark.createDataFrame([(1, "0", [0.0, 1.0]), (1, "1", [1.0, 0.0]), (2, "0", [0.5, 0.5])], "graph_id long, node_id string, x array<double>")
    assert sorted((r.graph_id, r.node_id, r.category) for r in collections.categories(x).collect()) == [(1, "0", 1), (1, "1", 0), (2, "0", None)]
    a = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, x array<double>")
    b = spark.createDataFrame([(5, [0.0, 2.0]), (6, [3.0, 0.0]), (7, [1.0, 0.0])], "id long, x array<double>")
    assert sorted(map(tuple, collections.aligned_by_rows(a, b).collect())) == [(0, 6, False), (1, 7, False), (2, 5, True)]
    nodes = spark.createDataFrame([(0, "c"), (3, "c"), (1, "d")], "id long, label string")
    texts = spark.createDataFrame([(0, "c", "one"), (1, "c", "two")], "id long, label string, text string")
    assert {r.id: r.text for r in collections.aligned_by_class(nodes, texts).collect()} == {0: "one", 3: "two", 1: "(no text; class d)"}
    kept = spark.createDataFrame([(1,), (2,)], "graph_id long")
    with pytest.raises(Exception, match="no finite embedding of graph 2"):
        collections.embeddings(spark.createDataFrame([(1, [1.0])], "graph_id long, features array<double>"), kept).collect()
    sinks.write_graphs(gs, str(tmp_path / "g"))
    assert collections.read_graphs(spark, str(tmp_path / "g")).edges.count() == gs.edges.count()


def test_generators(spark):
    gs, graphs = builtin.families(spark, 11, 2)
    sizes = {r.graph_id: r["count"] for r in gs.vertices.groupBy("graph_id").count().collect()}
    assert len(sizes) == 6 and all(20 <= n <= 40 for n in sizes.values()) and [r.label for r in graphs.orderBy("graph_id").collect()] == ["ER", "ER", "BA", "BA", "WS", "WS"]
    for f in builtin.FAMILIES:
        n, edges = builtin.family_graph(f, 3, 1)
        assert builtin.connected(n, edges) and (n, edges) == builtin.family_graph(f, 3, 1)
    sbm = builtin.blocks(spark, 5)
    assert sbm.vertices.count() == 120 and 250 < sbm.edges.count() < 550


def test_stream(spark, tmp_path):
    from knotwork.streaming.counts import running_degrees, running_sizes

    spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "b", "c"), (1, "c", "c")], "graph_id long, src string, dst string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "s"))
    source = lambda: spark.readStream.schema("graph_id long, src string, dst string, ts timestamp").parquet(str(tmp_path / "s"))
    for name, df, want in (("deg", running_degrees(source()), {("a", 1), ("b", 2), ("c", 1)}), ("siz", running_sizes(source()), {(2,)})):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / f"c{name}")).start()
        q.processAllAvailable()
        q.stop()
        assert {tuple(r)[1:] for r in spark.sql(f"select * from {name}").collect()} == want
