import math

import duckdb
import pytest

import __spark_entry__ as entry
from knotwork import queries as graph

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "graph_size", "triangles_clustering", "four_cycles", "components", "betweenness", "null_models", "attr_assortativity", "cross_edges", "ego_graph", "link_features", "negative_pairs", "kg_ranking_scores", "regret_summary",
    "aligned_rows", "class_texts", "embedding_scan", "element_lines", "mean_predictor", "kg_both_ways", "kg_skeleton", "pending_runs", "anonymous_members", "feature_vector_all", "kg_top_tails", "kg_contexts", "kg_without_tests", "one_graph_degrees", "one_graph_components", "one_graph_mixing",
    "component_of_node", "query_order", "kg_entities", "closeness"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


def test_entry(spark):
    assert entry.entry(spark).count() == 150


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(graph.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, rel = graph.queries()[name](spark, sf), con.sql(graph.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in order) for r in rel.fetchall()), key=repr)
    assert got == want
