"""Facts of small graphs that need a dense matrix or an ordered agglomeration, in numpy; of larger ones by rounds over tables.

A small graph comes as one row of arrays (at most Caps.dense nodes); a task works through a
batch of graphs. Distances and path counts go level by level for all sources at once,
as matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.durable import durable
from knotwork.model import NO_CAP, Caps, GraphSet
from knotwork.operators import iterative

UNREACHED = -1


def adjacency(n: int, edges: np.ndarray) -> np.ndarray:
    a = np.zeros((n, n))
    if len(edges):
        a[edges[:, 0], edges[:, 1]] = a[edges[:, 1], edges[:, 0]] = 1.0
    return a


def distances(a: np.ndarray, sources: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """dist (UNREACHED where there is no path) and the number of shortest paths, by source row."""
    n = len(a)
    rows = np.arange(n) if sources is None else sources
    dist = np.full((len(rows), n), UNREACHED)
    paths = np.zeros((len(rows), n))
    at = np.arange(len(rows))
    dist[at, rows], paths[at, rows] = 0, 1.0
    level, front = 0, paths.copy()
    while front.any():
        reach = front @ a
        new = (reach > 0) & (dist == UNREACHED)
        level += 1
        dist[new] = level
        front = np.where(new, reach, 0.0)
        paths += front
    return dist, paths


def betweenness(a: np.ndarray, dist: np.ndarray, paths: np.ndarray) -> np.ndarray:
    """Normalised betweenness from the sources of dist, scaled up if they are a sample."""
    n, k = len(a), len(dist)
    if n <= 2 or not k:
        return np.zeros(n)
    depend = np.zeros_like(paths)
    for level in range(int(dist.max()), 0, -1):
        on = dist == level
        share = np.divide(1.0 + depend, paths, out=np.zeros_like(paths), where=on & (paths > 0))
        depend += np.where(dist == level - 1, paths * (share @ a), 0.0)
    depend[dist == 0] = 0.0
    return depend.sum(0) / ((n - 1) * (n - 2)) * (n / k)


def closeness(dist: np.ndarray) -> np.ndarray:
    """Reached share times inverse mean distance; 0 for isolated nodes."""
    n = len(dist)
    near = dist > 0
    reached, total = near.sum(1), np.where(near, dist, 0).sum(1)
    return np.divide(reached * reached, total * (n - 1.0), out=np.zeros(n), where=total > 0)


def components(dist: np.ndarray) -> np.ndarray:
    """Each node's smallest reachable node."""
    return (dist != UNREACHED).argmax(1) if len(dist) else np.empty(0, int)


def eigenvector(a: np.ndarray) -> tuple[np.ndarray, bool]:
    """The principal eigenvector with a sum >= 0, and whether the top eigenvalue is not simple."""
    if not len(a) or not a.any():
        return np.zeros(len(a)), False
    values, vectors = np.linalg.eigh(a)
    x = vectors[:, -1]
    return (-x if x.sum() < 0 else x), len(a) > 1 and bool(values[-1] - values[-2] < 1e-9)


def spectral_gap(a: np.ndarray) -> float:
    """The second smallest Laplacian eigenvalue of a connected graph; 0 for a single node."""
    return float(np.linalg.eigvalsh(np.diag(a.sum(1)) - a)[1]) if len(a) > 1 else 0.0


def core_numbers(a: np.ndarray) -> np.ndarray:
    """Peel nodes of degree <= k for k = 0, 1, ...; a node's core is the k at which it goes."""
    left, deg = np.ones(len(a), bool), a.sum(1)
    core, k = np.zeros(len(a), int), 0
    while left.any():
        go = left & (deg <= k)
        if not go.any():
            k += 1
            continue
        core[go] = k
        left &= ~go
        deg = deg - a[:, go].sum(1)
    return core


def communities(n: int, edges: np.ndarray) -> list[list[int]]:
    """Greedy modularity: merge the two linked communities of largest gain while it is not negative.

    Equal gains go to the pair whose communities hold the smallest first nodes. Largest
    communities first, then by first node. Without edges every node is its own. A heap
    holds the gain of every link; entries that a merge has made stale are passed over.
    """
    two_m = 2 * len(edges)
    links: list[dict[int, int]] = [{} for _ in range(n)]
    for u, v in edges.tolist():
        links[u][v] = links[v][u] = 1
    ends = [len(x) for x in links]
    members = {v: [v] for v in range(n)}
    # A community is named by its first node. Losses are -gain * 2m * m, in whole numbers.
    heap = [(ends[u] * ends[v] - two_m, u, v) for u in range(n) for v in links[u] if u < v]
    heapify(heap)
    while heap and heap[0][0] <= 0:
        loss, u, v = heappop(heap)
        if v not in links[u] or ends[u] * ends[v] - two_m * links[u][v] != loss:
            continue
        del links[u][v], links[v][u]
        for x, w in links[v].items():
            del links[x][v]
            links[u][x] = links[x][u] = links[u].get(x, 0) + w
        links[v] = {}
        ends[u] += ends[v]
        members[u] += members.pop(v)
        for x, w in links[u].items():
            heappush(heap, (ends[u] * ends[x] - two_m * w, min(u, x), max(u, x)))
    return sorted((sorted(c) for c in members.values()), key=lambda c: (-len(c), c[0]))


def modularity(n: int, edges: np.ndarray, parts: list[list[int]]) -> float:
    m = len(edges)
    if not m:
        return 0.0
    of = np.empty(n, int)
    for i, c in enumerate(parts):
        of[c] = i
    a, b = of[edges[:, 0]], of[edges[:, 1]]
    inside = np.bincount(a[a == b], minlength=len(parts))
    ends = np.bincount(a, minlength=len(parts)) + np.bincount(b, minlength=len(parts))
    return float((inside / m - (ends / (2 * m)) ** 2).sum())


def ring_sizes(n: int, edges: np.ndarray, a: np.ndarray, dist: np.ndarray, caps: Caps) -> dict[int, int] | None:
    """Lengths in a minimum cycle basis: the shortest independent cycles of Horton's candidates."""
    m = len(edges)
    if n < 3 or m < n:
        return {}
    if n > caps.ring_nodes or m > caps.ring_edges or m - n > caps.ring_excess:
        return None
    number = {(u, v): i for i, (u, v) in enumerate(edges.tolist())} | {(v, u): i for i, (u, v) in enumerate(edges.tolist())}
    near = [np.flatnonzero(r).tolist() for r in a]
    found = []
    for root in range(n):
        d = dist[root]
        path, parent, branch = {root: 0}, {}, {root: root}
        for v in sorted(np.flatnonzero(d > 0).tolist(), key=lambda v: (d[v], v)):
            p = next(u for u in near[v] if d[u] == d[v] - 1)
            parent[v], path[v] = p, path[p] | 1 << number[p, v]
            branch[v] = v if p == root else branch[p]
        for u, v in edges.tolist():
            if u in path and v in path and parent.get(u) != v and parent.get(v) != u and branch[u] != branch[v]:
                found.append((int(d[u] + d[v]) + 1, path[u] | path[v] | 1 << number[u, v]))
    rank = m - n + len(set(components(dist).tolist()))
    basis: dict[int, int] = {}
    sizes: dict[int, int] = {}
    for length, cycle in sorted(set(found)):
        if len(basis) == rank:
            break
        while cycle:
            top = cycle.bit_length()
            if top not in basis:
                basis[top] = cycle
                sizes[length] = sizes.get(length, 0) + 1
                break
            cycle ^= basis[top]
    return dict(sorted(sizes.items()))


#: Parts of the dense facts that a caller can ask for; what is not asked for is null.
PARTS = frozenset({"betweenness", "closeness", "eigenvector", "communities", "cores", "spectrum", "rings"})


def graph_facts(graph_id, nodes: list[str], edges: np.ndarray, caps: Caps, parts: frozenset = PARTS) -> dict:
    """The dense facts of one graph, components and distances always; edges as pairs of places in nodes."""
    n = len(nodes)
    a = adjacency(n, edges)
    dist, paths = distances(a)
    comp = components(dist)
    sizes = np.bincount(comp, minlength=n) if n else np.empty(0, int)
    lcc = comp == int(sizes.argmax()) if n else np.empty(0, bool)
    size = int(lcc.sum())
    apl = diameter = radius = None
    if size > 1 and size <= caps.paths:
        inner = dist[np.ix_(lcc, lcc)]
        reach = inner.max(1)
        apl, diameter, radius = float(inner.sum() / (size * (size - 1))), int(reach.max()), int(reach.min())
    elif size <= 1:
        apl, diameter, radius = 0.0, 0, 0
    out = {
        "graph_id": graph_id, "n_components": len(set(comp.tolist())), "lcc_size": size, "avg_path_length": apl, "diameter": diameter, "radius": radius,
    }
    node: dict[str, list] = {}
    if "betweenness" in parts:
        some = dist, paths
        if n > caps.exact_betweenness:
            pivots = np.sort(np.random.default_rng(0).choice(n, min(caps.pivots, n), replace=False))
            some = dist[pivots], paths[pivots]
        between = betweenness(a, *some)
        out |= {"betweenness_mean": float(between.mean()) if n else 0.0, "betweenness_max": float(between.max()) if n else 0.0}
        node["betweenness"] = between.tolist()
    if "closeness" in parts:
        near = closeness(dist)
        out["closeness_mean"] = float(near.mean()) if n else 0.0
        node["closeness"] = near.tolist()
    if "eigenvector" in parts:
        eig, degenerate = eigenvector(a)
        out |= {"eigenvector_mean": float(eig.mean()) if n else 0.0, "eigenvector_max": float(eig.max()) if n else 0.0, "eig_degenerate": degenerate}
        node["eigenvector"] = eig.tolist()
    if "communities" in parts:
        found = communities(n, edges)
        out |= {"n_communities": len(found), "modularity": modularity(n, edges, found)}
        of = {v: i for i, c in enumerate(found) for v in c}
        node["community"] = [of[i] for i in range(n)]
    if "cores" in parts:
        core = core_numbers(a)
        out["max_kcore"] = int(core.max()) if n and len(edges) else 0
        node["core"] = core.tolist()
    if "spectrum" in parts:
        out["spectral_gap"] = spectral_gap(a[np.ix_(lcc, lcc)])
    if "rings" in parts:
        rings = ring_sizes(n, edges, a, dist, caps)
        out["ring_sizes"] = None if rings is None else list(rings.items())
    three = [k for k in ("betweenness", "eigenvector", "closeness") if k in node]
    order = comp.tolist()
    out["nodes"] = [
        {"node_id": v, "node_ord": i, "component": order[i], **{k: x[i] for k, x in node.items()}, "rounded": {k: round(node[k][i], 3) for k in three}}  # as Python rounds
        for i, v in enumerate(nodes)
    ]
    return out


_NODE = pa.struct([("node_id", pa.string()), ("node_ord", pa.int32()), ("component", pa.int32()), ("betweenness", pa.float64()), ("closeness", pa.float64()), ("eigenvector", pa.float64()), ("community", pa.int32()), ("core", pa.int32()), ("rounded", pa.struct([(k, pa.float64()) for k in ("betweenness", "eigenvector", "closeness")]))])
_OUT = pa.schema([
    ("graph_id", pa.int64()), ("n_components", pa.int64()), ("lcc_size", pa.int64()), ("avg_path_length", pa.float64()), ("diameter", pa.int64()), ("radius", pa.int64()),
    ("n_communities", pa.int64()), ("modularity", pa.float64()), ("max_kcore", pa.int64()), ("spectral_gap", pa.float64()), ("ring_sizes", pa.map_(pa.int32(), pa.int32())),
    ("betweenness_mean", pa.float64()), ("betweenness_max", pa.float64()), ("closeness_mean", pa.float64()), ("eigenvector_mean", pa.float64()), ("eigenvector_max", pa.float64()),
    ("eig_degenerate", pa.bool_()), ("nodes", pa.list_(_NODE)),
])
KERNEL_SCHEMA = (
    "graph_id long, n_components long, lcc_size long, avg_path_length double, diameter long, radius long, n_communities long, modularity double, max_kcore long, spectral_gap double, "
    "ring_sizes map<int,int>, betweenness_mean double, betweenness_max double, closeness_mean double, eigenvector_mean double, eigenvector_max double, eig_degenerate boolean, "
    "nodes array<struct<node_id:string,node_ord:int,component:int,betweenness:double,closeness:double,eigenvector:double,community:int,core:int,rounded:struct<betweenness:double,eigenvector:double,closeness:double>>>"
)


def graph_rows(gs: GraphSet, least: int = 0, most: int | None = None) -> DataFrame:
    """graph_id, nodes, src, dst: one row per graph of `least` to `most` (Caps.dense if None) nodes."""
    v = gs.vertices.select("graph_id", "node_id", "node_ord")
    small = v.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(least, gs.caps.dense if most is None else most)).select("graph_id")
    v = v.join(small, "graph_id", "left_semi")
    nodes = v.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node_ord", "node_id"))).alias("nodes"))
    pairs = gs.edges.join(small, "graph_id", "left_semi").groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("edges"))
    out = nodes.join(pairs, "graph_id", "left")
    return out.select("graph_id", F.col("nodes.node_id").alias("nodes"), F.col("edges.src").alias("src"), F.col("edges.dst").alias("dst"))


def placed(row: dict) -> np.ndarray:
    """The edges of a row of graph_rows as sorted pairs of places in its nodes."""
    at = {v: i for i, v in enumerate(row["nodes"])}
    pairs = sorted(tuple(sorted((at[u], at[v]))) for u, v in zip(row["src"] or (), row["dst"] or (), strict=True))
    return np.array(pairs, int).reshape(-1, 2)


def labels(n: int, edges: np.ndarray) -> np.ndarray:
    """Each node's smallest reachable node, from edges alone."""
    low = np.arange(n)
    while len(edges):
        least = np.minimum(low[edges[:, 0]], low[edges[:, 1]])
        new = low.copy()
        for side in (0, 1):
            np.minimum.at(new, edges[:, side], least)
            np.minimum.at(new, low[edges[:, side]], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == low).all():
            break
        low = new
    return low


class Sparse:
    """Edges as the symmetric matrix of a graph that is too large for a dense one."""

    def __init__(self, n: int, edges: np.ndarray):
        self.n = n
        self.rows = np.concatenate([edges[:, 0], edges[:, 1]])
        self.columns = np.concatenate([edges[:, 1], edges[:, 0]])
        self.degrees = np.bincount(self.rows, minlength=n).astype(float)

    def times(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, x[self.columns], self.n)

    def listed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes with neighbours, where each one's list begins, and the lists one after the other."""
        some = np.flatnonzero(self.degrees)
        ends = np.cumsum(self.degrees[some]).astype(int)
        return some, ends - self.degrees[some].astype(int), self.columns[np.argsort(self.rows, kind="stable")]

    def solve(self, b: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
        """The Laplacian's pseudo-inverse times b, of a connected graph, by conjugate gradients preconditioned with the degrees."""
        x, r = np.zeros(self.n), b - b.mean()
        z = r / self.degrees
        p, rz, stop = z, r @ z, tolerance * np.linalg.norm(r)
        for _ in range(10 * self.n):
            if np.linalg.norm(r) <= stop:
                break
            q = self.degrees * p - self.times(p)
            step = rz / (p @ q)
            x, r = x + step * p, r - step * q
            z = r / self.degrees
            new = r @ z
            p, rz = z + new / rz * p, new
        return x - x.mean()


def top_pair(apply, start: np.ndarray, steps: int = 60, tolerance: float = 1e-11, rounds: int = 200) -> tuple[float, np.ndarray, bool]:
    """The largest eigenvalue of a symmetric operator, its vector, and whether the residual came down to the tolerance.

    Lanczos with full reorthogonalisation, begun anew from the best vector after every
    `steps` steps.
    """
    x = start / np.linalg.norm(start)
    value = 0.0
    for _ in range(rounds):
        basis, images = [x], []
        while True:
            w = apply(basis[-1])
            images.append(w)
            q = np.array(basis)
            w = w - q.T @ (q @ w)
            w = w - q.T @ (q @ w)
            norm = float(np.linalg.norm(w))
            if len(basis) == min(steps, len(x)) or norm <= 1e-13 * max(1.0, abs(value)):
                break
            basis.append(w / norm)
        q, image = np.array(basis), np.array(images)
        small = q @ image.T
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        value, best = float(values[-1]), vectors[:, -1]
        x = q.T @ best
        if np.linalg.norm(image.T @ best - value * x) <= tolerance * max(abs(value), 1e-300):
            return value, x / np.linalg.norm(x), True
        x = x / np.linalg.norm(x)
    return value, x, False


def large_spectrum(n: int, edges: np.ndarray, low: np.ndarray, dense: int) -> tuple[np.ndarray, bool, float | None]:
    """The principal eigenvector, whether its eigenvalue is not simple, and the spectral gap of the largest component.

    A connected graph's principal eigenvalue is simple, so each component gives one, and
    two equal ones make it degenerate. Components of up to `dense` nodes are dense
    matrices; a component whose largest degree is below the best value so far is passed
    over. The gap is the inverse of the largest eigenvalue of the Laplacian's
    pseudo-inverse; it is None where the iteration does not settle.
    """
    names, sizes = np.unique(low, return_counts=True)
    order = np.lexsort((names, -sizes))
    mine = np.argsort(low, kind="stable")
    starts = dict(zip(names.tolist(), np.cumsum([0, *sizes[:-1]]).tolist(), strict=True))
    inside = edges[np.argsort(low[edges[:, 0]], kind="stable")]
    cut = np.searchsorted(low[inside[:, 0]], [names, names + 1])
    x, best, ties, gap = np.zeros(n), 0.0, 0, 0.0
    place = np.empty(n, int)
    for rank, i in enumerate(order.tolist()):
        nodes = mine[starts[int(names[i])] :][: sizes[i]]
        place[nodes] = np.arange(len(nodes))
        own = place[inside[cut[0, i] : cut[1, i]]].reshape(-1, 2)
        small = len(nodes) <= dense
        if rank == 0 and len(nodes) > 1:
            if small:
                gap = spectral_gap(adjacency(len(nodes), own))
            else:
                s = Sparse(len(nodes), own)
                value, _, settled = top_pair(s.solve, np.random.default_rng(0).standard_normal(len(nodes)), 20, 1e-9)
                gap = 1 / value if settled else None
        if not len(own) or np.bincount(own.ravel()).max() < best - 1e-9:
            continue
        if small:
            values, vectors = np.linalg.eigh(adjacency(len(nodes), own))
            value, vector = float(values[-1]), vectors[:, -1]
        else:
            value, vector, _ = top_pair(Sparse(len(nodes), own).times, np.ones(len(nodes)))
        ties = ties + 1 if abs(value - best) < 1e-9 else 0 if value > best else ties
        if value > best + 1e-9:
            best, x = value, np.zeros(n)
            x[nodes] = vector if vector.sum() >= 0 else -vector
    return x, ties > 0, gap


def peeled(n: int, edges: np.ndarray) -> np.ndarray:
    """Core numbers from lists of neighbours, the node of least degree first."""
    s = Sparse(n, edges)
    order = np.argsort(s.rows, kind="stable")
    near, ends = s.columns[order].tolist(), np.concatenate([[0], np.cumsum(s.degrees)]).astype(int).tolist()
    deg = s.degrees.astype(int).tolist()
    heap = [(d, v) for v, d in enumerate(deg)]
    heapify(heap)
    core, k = [-1] * n, 0
    while heap:
        d, v = heappop(heap)
        if core[v] >= 0 or d != deg[v]:
            continue
        k = max(k, d)
        core[v] = k
        for u in near[ends[v] : ends[v + 1]]:
            if core[u] < 0:
                deg[u] -= 1
                heappush(heap, (deg[u], u))
    return np.array(core, np.int64)


_LARGE = pa.schema([
    ("graph_id", pa.int64()), ("n_communities", pa.int64()), ("modularity", pa.float64()), ("of", pa.list_(pa.int32())), ("spectral_gap", pa.float64()), ("eig_degenerate", pa.bool_()),
    ("eig", pa.list_(pa.float64())), ("cores", pa.list_(pa.int32())),
])


def large_communities(gs: GraphSet) -> DataFrame:
    """Facts of graphs of Caps.dense to Caps.merged nodes that take a whole graph, with node values by place of the node.

    graph_id, n_communities, modularity, of (communities), spectral_gap, eig_degenerate,
    eig (the eigenvector), cores. The agglomeration is ordered and the spectrum
    iterates, so one task holds a graph; its memory grows with the edges and with 60
    vectors, not with the square of the nodes.
    """
    dense = gs.caps.dense

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                n, edges = len(row["nodes"]), placed(row)
                parts = communities(n, edges)
                of = np.empty(n, np.int32)
                for c, part in enumerate(parts):
                    of[part] = c
                eig, degenerate, gap = large_spectrum(n, edges, labels(n, edges), dense)
                yield pa.RecordBatch.from_pylist([{
                    "graph_id": row["graph_id"], "n_communities": len(parts), "modularity": modularity(n, edges, parts), "of": of.tolist(), "spectral_gap": gap, "eig_degenerate": degenerate,
                    "eig": eig.tolist(), "cores": peeled(n, edges).tolist(),
                }], schema=_LARGE)

    schema = "graph_id long, n_communities long, modularity double, of array<int>, spectral_gap double, eig_degenerate boolean, eig array<double>, cores array<int>"
    return graph_rows(gs, gs.caps.dense + 1, gs.caps.merged).mapInArrow(run, schema)


#: Parts that the sources of a large graph are dealt to, and numbers that a part's searches hold at a time.
SEARCHES, HELD_NUMBERS = 64, 1 << 23


def searched(lists: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, sources: np.ndarray, depend_on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each source the nodes it reaches, their total and largest distance; of each node what it owes to those in depend_on (Brandes)."""
    some, starts, near = lists
    at = np.arange(len(sources))

    def pulled(x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        if len(some):
            out[some] = np.add.reduceat(x[near], starts, axis=0)
        return out

    dist, paths = np.full((n, len(sources)), UNREACHED, np.int32), np.zeros((n, len(sources)))
    dist[sources, at], paths[sources, at] = 0, 1.0
    level, front = 0, paths.copy()
    while front.any():
        reach = pulled(front)
        new = (reach > 0) & (dist == UNREACHED)
        level += 1
        dist[new] = level
        front = np.where(new, reach, 0.0)
        paths += front
    found = (dist > 0).sum(0), np.where(dist > 0, dist, 0).sum(0, dtype=np.int64), dist.max(0)
    dist, paths, at = dist[:, depend_on], paths[:, depend_on], np.arange(int(depend_on.sum()))
    depend = np.zeros_like(paths)
    for back in range(level if len(at) else 0, 0, -1):
        share = np.divide(1.0 + depend, paths, out=np.zeros_like(paths), where=dist == back)
        depend += np.where(dist == back - 1, paths * pulled(share), 0.0)
    depend[sources[depend_on], at] = 0.0
    return *found, depend.sum(1)


def large_paths(gs: GraphSet, between: bool = True) -> DataFrame:
    """graph_id, node_ord (the node's place), sources, depend, reached, total, farthest of graphs of more than Caps.dense nodes.

    Searches from all nodes, dealt to SEARCHES tasks a graph, each with the lists of
    neighbours and a few sources at a time; only sums by node leave a task. Betweenness
    depends on `sources` sources, all of them up to Caps.exact_betweenness nodes.
    """
    caps = gs.caps

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                edges = placed(row)
                yield pa.RecordBatch.from_pydict({"graph_id": [row["graph_id"]], "n": pa.array([len(row["nodes"])], pa.int32()), "a": pa.array([edges[:, 0]], pa.list_(pa.int32())), "b": pa.array([edges[:, 1]], pa.list_(pa.int32()))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, part = (batch.column(c)[i].as_py() for c in ("n", "part"))
                edges = np.stack([batch.column(c)[i].values.to_numpy() for c in ("a", "b")], 1).astype(int)
                lists = Sparse(n, edges).listed()
                pivots = np.zeros(n, bool)
                if between and n > caps.exact_betweenness:
                    pivots[np.random.default_rng(0).choice(n, min(caps.pivots, n), replace=False)] = True
                elif between:
                    pivots[:] = True
                depend, own = np.zeros(n), np.full((3, n), -1, np.int64)
                mine, few = np.arange(part, n, SEARCHES), max(1, HELD_NUMBERS // (2 * len(edges) + 8 * n))
                for lo in range(0, len(mine), few):
                    sources = mine[lo : lo + few]
                    *own[:, sources], more = searched(lists, n, sources, pivots[sources])
                    depend += more
                names = ("graph_id", "node_ord", "sources", "depend", "reached", "total", "farthest")
                columns = ([batch.column("graph_id")[i].as_py()] * n, pa.array(range(n), pa.int32()), pa.array([int(pivots.sum())] * n, pa.int64()), depend, *own)
                yield pa.RecordBatch.from_pydict(dict(zip(names, columns, strict=True)))

    lists = durable(graph_rows(gs, caps.dense + 1, NO_CAP).mapInArrow(place, "graph_id long, n int, a array<int>, b array<int>"))
    dealt = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(SEARCHES)) - 1))).repartition(min(10_000, lists.count() * SEARCHES), "graph_id", "part")
    rows = dealt.mapInArrow(run, "graph_id long, node_ord int, sources long, depend double, reached long, total long, farthest long")
    return rows.groupBy("graph_id", "node_ord").agg(F.max("sources").alias("sources"), F.sum("depend").alias("depend"), *[F.max(c).alias(c) for c in ("reached", "total", "farthest")])


#: Facts that take a whole graph in one task.
_WHOLE = frozenset({"communities", "spectrum", "cores", "eigenvector"})


def large_facts(gs: GraphSet, parts: frozenset = PARTS) -> DataFrame:
    """The columns of kernel_facts for graphs of more than Caps.dense nodes.

    Distances, closeness and betweenness come from searches that are dealt to tasks. Up
    to Caps.merged nodes a task works out communities, cores and the spectrum of a
    graph; above, cores and the eigenvector come from rounds over tables, and
    communities, eig_degenerate and spectral_gap (of more than one node) are null.
    """
    caps, key = gs.caps, ["graph_id", "node_id"]
    gs = gs.stored()
    size = gs.degrees.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), (F.sum("deg") / 2).cast("long").alias("m"))
    order = Window.partitionBy("graph_id").orderBy("node_ord", "node_id")
    nodes = gs.vertices.select("graph_id", "node_id", (F.row_number().over(order) - 1).alias("node_ord"))
    nodes = durable(nodes.join(iterative.components(gs), key))
    first = nodes.groupBy("graph_id", "component").agg(F.min("node_ord").alias("first"), F.count(F.lit(1)).alias("size"))
    best = F.max_by("first", F.struct("size", -F.col("first"))).alias("best")
    largest = first.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_components"), F.max("size").alias("lcc_size"), best)
    paths = large_paths(gs, "betweenness" in parts).join(size.select("graph_id", "n"), "graph_id")
    n, reached = F.col("n"), F.col("reached")
    paths = paths.withColumns({
        "betweenness": F.when((n > 2) & (F.col("sources") > 0), F.col("depend") / ((n - 1) * (n - 2)) * n / F.col("sources")).otherwise(F.lit(0.0)),
        "closeness": F.when(F.col("total") > 0, reached * reached / (F.col("total") * (n - 1))).otherwise(F.lit(0.0)),
    }).drop("n", "sources", "depend", "reached")
    whole = large_communities(gs)
    merged = durable(whole) if parts & _WHOLE else whole.sparkSession.createDataFrame([], whole.schema)
    per = nodes.join(first.drop("size"), ["graph_id", "component"]).join(merged.select("graph_id", "of", "eig", "cores"), "graph_id", "left")
    per = durable(per.join(paths, ["graph_id", "node_ord"]))
    size_of = F.max("lcc_size")
    apl = F.when(size_of > 1, F.sum("total") / (size_of * (size_of - 1))).otherwise(F.lit(0.0))
    inner = per.join(largest.select("graph_id", "lcc_size", F.col("best").alias("first")), ["graph_id", "first"])
    reach = inner.groupBy("graph_id").agg(apl.alias("avg_path_length"), F.max("farthest").alias("diameter"), F.min("farthest").alias("radius"))
    per = per.drop("total", "farthest")
    eig, core = F.get("eig", F.col("node_ord")), F.get("cores", F.col("node_ord"))
    larger = size.filter(F.col("n") > caps.merged).select("graph_id")
    if not parts & _WHOLE or larger.isEmpty():
        per = per.withColumns({"eigenvector": eig, "core": core})
    else:
        beyond = GraphSet(gs.vertices, gs.edges, caps).only(larger).stored()
        rounds = iterative.eigenvector(beyond).withColumnRenamed("eigenvector", "x").join(iterative.core_numbers(beyond).withColumnRenamed("core", "c"), key)
        per = per.join(rounds, key, "left").withColumns({"eigenvector": F.coalesce(eig, "x"), "core": F.coalesce(core, "c")}).drop("x", "c")
    per = per.drop("eig", "cores")
    rounded = F.struct(*[F.round(c, 3).alias(c) for c in ("betweenness", "eigenvector", "closeness")]).alias("rounded")
    entry = F.struct(
        "node_id", F.col("node_ord").cast("int").alias("node_ord"), F.col("first").cast("int").alias("component"), "betweenness", "closeness", "eigenvector",
        F.get("of", F.col("node_ord")).alias("community"), F.col("core").cast("int").alias("core"), rounded,
    )
    facts = per.groupBy("graph_id").agg(
        F.max("core").cast("long").alias("max_kcore"), F.avg("betweenness").alias("betweenness_mean"), F.max("betweenness").alias("betweenness_max"), F.avg("closeness").alias("closeness_mean"),
        F.avg("eigenvector").alias("eigenvector_mean"), F.max("eigenvector").alias("eigenvector_max"), F.array_sort(F.collect_list(F.struct("node_ord", entry.alias("entry"))))["entry"].alias("nodes"),
    )
    out = size.join(largest.drop("best"), "graph_id").join(reach, "graph_id").join(merged.drop("of", "eig", "cores"), "graph_id", "left").join(facts, "graph_id")
    few = F.col("lcc_size") <= caps.paths
    out = out.withColumns({c: F.when(few, F.col(c)).cast(t) for c, t in (("avg_path_length", "double"), ("diameter", "long"), ("radius", "long"))})
    out = out.withColumns({
        "spectral_gap": F.when(F.col("lcc_size") <= 1, F.lit(0.0)).otherwise(F.col("spectral_gap")),
        "ring_sizes": F.when((F.col("n") < 3) | (F.col("m") < F.col("n")), F.create_map().cast("map<int,int>")),
    })
    return durable(out.select(*_OUT.names))


#: Nodes of graphs whose facts a task holds before it hands them on.
HELD_NODES = 20_000


def kernel_facts(gs: GraphSet, parts: frozenset = PARTS) -> DataFrame:
    """The facts of every graph, with a row for each node inside; graphs of more than Caps.dense nodes by large_facts.

    `parts` are the facts to work out beside components and distances; the others are
    null, or left over from what others need. A task turns one row at a time into facts.
    """
    caps = gs.caps
    large = durable(gs.vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > caps.dense).select("graph_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                out.append(graph_facts(row["graph_id"], row["nodes"], placed(row), caps, parts))
                size += len(row["nodes"])
                if size >= HELD_NODES:
                    yield pa.RecordBatch.from_pylist(out, schema=_OUT)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_OUT)

    small = graph_rows(gs).mapInArrow(run, KERNEL_SCHEMA)
    return small if large.isEmpty() else small.unionByName(large_facts(gs.only(large), parts))


#: Nodes of a graph whose components one task finds.
LISTED = 100_000


def components_of(gs: GraphSet) -> DataFrame:
    """graph_id, node_id, component: the smallest node_id reachable; small graphs a row each, large ones by rounds."""
    most = min(gs.caps.merged, LISTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                top = {v: v for v in row["nodes"]}

                def root(v: str) -> str:
                    while top[v] != v:
                        top[v] = v = top[top[v]]
                    return v

                for u, v in zip(row["src"] or (), row["dst"] or (), strict=True):
                    u, v = root(u), root(v)
                    top[max(u, v)] = min(u, v)
                names = row["nodes"]
                yield pa.RecordBatch.from_pydict({"graph_id": pa.array([row["graph_id"]] * len(names), pa.int64()), "node_id": pa.array(names), "component": pa.array([root(v) for v in names])})

    large = durable(gs.vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("graph_id"))
    small = graph_rows(gs, 0, most).mapInArrow(run, "graph_id long, node_id string, component string")
    return small if large.isEmpty() else small.unionByName(iterative.components(gs.only(large)))


def node_facts(kernel: DataFrame) -> DataFrame:
    """graph_id and the facts of every node, from kernel_facts."""
    return kernel.select("graph_id", F.explode("nodes").alias("n")).select("graph_id", "n.*")
