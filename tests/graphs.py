"""Small graphs for tests, many in one collection."""

from itertools import combinations

import numpy as np

from knotwork.model import graph_set


def collection(spark, graphs: dict[int, tuple[int, list[tuple[int, int]]]], attrs=None):
    """graphs: id -> (nodes, edges)."""
    vertices = [(g, str(v), v, (attrs or {}).get((g, v), {})) for g, (n, _) in graphs.items() for v in range(n)]
    edges = [(g, str(u), str(v), i) for g, (_, es) in graphs.items() for i, (u, v) in enumerate(es)]
    v = spark.createDataFrame(vertices, "graph_id long, node_id string, node_ord int, attrs map<string,string>")
    return graph_set(spark.createDataFrame(edges, "graph_id long, src string, dst string, edge_ord int"), v)


def complete(n):
    return n, list(combinations(range(n), 2))


def cycle(n):
    return n, [(i, (i + 1) % n) for i in range(n)]


def star(n):
    return n, [(0, i) for i in range(1, n)]


def path(n):
    return n, [(i, i + 1) for i in range(n - 1)]


def bipartite(a, b):
    return a + b, [(i, a + j) for i in range(a) for j in range(b)]


def random_graph(seed, n=12, p=0.25):
    rng = np.random.default_rng(seed)
    return n, [e for e in combinations(range(n), 2) if rng.random() < p]
