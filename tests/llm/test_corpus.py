"""Near-duplicates, line de-duplication, search, mixing, sharding, the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from knotwork.llm import bitsliced, line_dedup, mixing, near_dedup, shard_tree
from knotwork.llm.components import connected_components


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


# -- op4


def brute_components(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    at = {i: i for i in sets}

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for a in ids:
        for b in ids:
            if a < b and top(a) != top(b) and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                at[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


def near_copies(seed=3):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 900, 150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):  # from equal to quite different, some edited from edited ones
        w = list(base if i % 3 else words(rows[int(rng.integers(len(rows)))][1]))
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(len(w)))] = f"new{rng.integers(10**6)}"
        rows.append((i * 7 % 61, " ".join(w).upper() if i % 5 == 0 else "  ".join(w)))
    return rows


def test_near_duplicates(docs, clashing):
    rows = near_copies() + [(100, "a b c"), (101, "A  b\tc"), (102, "a b d"), (103, ""), (104, None), (105, ""), (106, "x " * 40_000), (107, "x " * 39_990 + "y"), (None, "a b c"), (100, "a b c"), (108, "solo text of five words more")]
    want = brute_components(rows)
    out = near_dedup.link_documents(clashing(docs(rows)))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.count() == len(rows)
    for r in out.collect():
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id]), r
        assert r.kept == (r.component_id == r.doc_id)
    by = {r.doc_id: r.n_shingles for r in out.collect()}
    assert by[100] == 1 and by[103] == by[104] == 0 and by[106] == 1
    kept = near_dedup.keep_one(clashing(docs(rows)))
    assert {r.doc_id for r in kept.collect()} == {None} | {i for i, c in want.items() if i == c}
    assert near_dedup.link_documents(docs(rows).limit(0)).count() == 0


def test_buckets_that_span_components(docs, monkeypatch):
    """Chains and near misses around one text, compared in blocks of a few members."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 50):
        w = list(base)
        for at in rng.choice(len(w), int(rng.integers(1, 5)), replace=False):
            w[at] = f"n{rng.integers(2)}"  # few new words, so that copies share their edits
        rows.append((i, " ".join(w)))
    want = brute_components(rows)
    assert 5 < len(set(want.values())) < 45
    got = near_dedup.link_documents(docs(rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_duplicates_of_a_document_with_two_texts(docs):
    short = [f"a{i}" for i in range(100)]
    rows = [(1, " ".join(short)), (1, " ".join(f"b{i}" for i in range(500))), (2, " ".join([*short[:-1], "other"])), (3, " ".join(f"c{i}" for i in range(50))), (3, None), (3, "")]
    want = brute_components(rows)
    assert want == {1: 1, 2: 1, 3: 3}
    out = near_dedup.link_documents(docs(rows)).collect()
    assert len(out) == len(rows) and all(r.component_id == want[r.doc_id] for r in out)


def test_pigeonhole_plan():
    plan = near_dedup.chunk_plan()
    rng = np.random.default_rng(0)
    for _ in range(300):
        broken = set(rng.choice(near_dedup.CODES, near_dedup.RADIUS, replace=False).tolist())
        assert any(not broken & set(at) for at in plan)
    assert near_dedup.radius(64, 0.85, 1e-6) > 64 * 0.15


def test_pipeline_removes_near_copies_from_80_percent(spark, docs):
    import corpus_pipeline

    base = [f"w{i}" for i in range(600)]

    def edited(name, k):  # k words far apart: 596 - 5k shingles of the base are left
        return " ".join(f"{name}{i}" if i % 40 == 20 and i // 40 < k else w for i, w in enumerate(base))

    # Similarities to the base: 546/646 = 0.845, 536/656 = 0.817, 531/661 = 0.803, 526/666 = 0.790.
    for k, similar in ((10, 84), (12, 81), (13, 80), (14, 78)):
        rows = [(1, " ".join(base)), (2, edited("n", k)), (3, "another text of more than five words")]
        assert [100 * (596 - 5 * k) // (596 + 5 * k)] == [similar]
        kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs(rows), "").collect())
        assert kept == ([1, 3] if similar >= 80 else [1, 2, 3]), similar
        assert near_dedup.keep_one(docs(rows)).count() == 3
    rng = np.random.default_rng(0)
    within = near_dedup.radius_for(80)
    plan = near_dedup.chunk_plan(within=within)
    for _ in range(300):
        broken = set(rng.choice(near_dedup.CODES, within, replace=False).tolist())
        assert any(not broken & set(at) for at in plan)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(int(a), int(b)) for a, b in rng.integers(200, 260, (40, 2))]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    at = {x: x for e in edges for x in e}
    for _ in at:
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
    assert got == {x: c for x, c in at.items() if any(x in e and e[0] != e[1] for e in edges)}


# -- op8


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        p, d[0] = d[0], i + 1
        for j, y in enumerate(b):
            p, d[j + 1] = d[j + 1], min(d[j + 1] + 1, d[j] + 1, p + (x != y))
    return d[-1]


def brute_lines(rows):
    at = sorted({(i, n, x) for i, t in rows if i is not None and t is not None for n, x in enumerate(t.split("\n")) if x.strip(" ")})
    out = set()
    for i, n, x in at:
        alike = [(j, m, y) for j, m, y in at if (j, m) < (i, n) and abs(len(x) - len(y)) <= 1 and edits(x, y) <= 1]
        if alike:
            j, m, y = min(alike)
            out.add((i, n, j, m, int(y != x)))
    return out


def test_lines(docs, clashing):
    rng = np.random.default_rng(2)
    base = ["the same line again and again", "a", "ab", "für alle Fälle", "aaaa", "x" * 40, "tab\there"]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(4):
            x = base[int(rng.integers(len(base)))]
            if rng.random() < 0.6:
                k, kind = int(rng.integers(len(x))), int(rng.integers(3))
                x = x[:k] + ["", "é", "q" + x[k]][kind] + x[k + 1 :]
            parts.append(x)
        rows.append((i, "\n".join(parts)))
    rows += [(50, None), (51, ""), (52, "\n \n"), (None, base[0]), (3, rows[3][1]), (53, "long " * 30_000)]
    got = line_dedup.repeated_lines(clashing(docs(rows)))
    assert {tuple(r) for r in got.collect()} == brute_lines(rows) and got.count() == got.distinct().count()
    gone = {(r.doc_id, r.line_no) for r in got.collect()}
    texts = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs(rows)).collect()}
    for i, t in rows:
        want = t if t is None or i is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        assert texts[i] == want
    assert line_dedup.repeated_lines(docs(rows).limit(0)).count() == 0


def test_very_long_lines(docs, monkeypatch):
    """Edits anywhere in lines of 40,000 characters, found by cutting blocks again; other long lines stay."""
    rng = np.random.default_rng(9)
    long = "".join(rng.choice(list("abcdefgh "), 40_000))
    twins = [long[:k] + x + long[k + d :] for k, x, d in ((0, "", 1), (39_999, "", 1), (20_001, "Q", 1), (12_345, "Q", 0), (40_000, "Q", 0))]
    rows = [(0, "first\n" + long), *((i + 1, f"{i} own" * (i + 2) + f"\n{t}") for i, t in enumerate(twins)), (9, long[::-1]), (10, long[:20_000] + "QQ" + long[20_000:])]
    got = {tuple(r) for r in line_dedup.repeated_lines(docs(rows)).collect()}
    # The line of document 10 is two edits from the first one, and one from no other.
    assert got == {(i + 1, 1, 0, 1, 1) for i in range(len(twins))}


# -- op9


def brute_top(rows, k=5):
    whole = [(i, [math.floor(256 * float(np.float32(v))) for v in x]) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = set()
    for q, x in whole:
        if q % 50 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in whole if i != q and len(x) == len(y)))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("block,slices", [(16_384, 6), (64, 2), (64, 20)])
def test_top_k(spark, clashing, block, slices):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.3, 6).tolist()) for i in range(300)] + [(400 + i, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(9)] + [(500, [1.0, 2.0]), (550, [0.0, 0.0]), (501, None), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (None, [0.1] * 6), (600, [])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = bitsliced.quantised(clashing(t))
    got = bitsliced.top_k(q, q.filter("vec_id % 50 = 0"), 5, block, slices)
    assert {tuple(r) for r in got.collect()} == brute_top(rows)
    assert bitsliced.search_every(t.limit(0)).count() == 0


def test_top_k_of_repeated_ids(spark, monkeypatch):
    """Every row of a repeated id is a query, and a candidate for the others; queries in several blocks."""
    monkeypatch.setattr(bitsliced, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(6)
    rows = [(i % 60, rng.normal(0, 0.3, 4).tolist()) for i in range(200)] + [(0, [0.5] * 4)] * 3 + [(50, [1.0, 2.0]), (51, [3.0, 1.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = [(i, [math.floor(256 * float(np.float32(v))) for v in x]) for i, x in rows]
    want = []
    for a, (q, x) in enumerate(whole):
        if q % 50 == 0:
            scored = sorted((-sum(v * w for v, w in zip(x, y, strict=True)), i) for b, (i, y) in enumerate(whole) if a != b and len(x) == len(y))
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])]
    got = bitsliced.search_every(t.repartition(3))
    assert sorted(map(tuple, got.collect())) == sorted(want) and got.columns == ["query_id", "rank", "vec_id", "score"]
    huge = spark.createDataFrame([(0, [1e300]), (1, [1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        bitsliced.search_every(huge)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=130), st.integers(1, 7))
def test_bitmap_arithmetic(values, k):
    x = np.array(values, np.int64)[:, None]
    index = bitsliced.BlockIndex(np.arange(len(x)), x, 10)
    low = min(0, int(x.min()))
    total = bitsliced.add_slices({j: [p] * 3 for j, p in enumerate(index.planes[0])}, index.words)
    sums = np.zeros(len(x), np.int64)
    for j, s in enumerate(total):
        sums[index.rows(s)] += 1 << j
    assert (sums == 3 * (x[:, 0] - low)).all()
    sure, tied, value = bitsliced.top_rows(total, index.all, k)
    if len(x) >= k:
        assert value == np.sort(sums)[-k] and set(index.rows(sure)) == set(np.flatnonzero(sums > value)) and set(index.rows(tied)) == set(np.flatnonzero(sums == value))
    assert set(index.rows(bitsliced.at_least(total, index.all, 17))) == set(np.flatnonzero(sums >= 17))


# -- op10


def targets_of(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        share = left / sum(w[s] for s in open_)
        over = {s for s in open_ if share * w[s] > 3 * sizes[s]}
        if not over:
            return out | {s: share * w[s] for s in open_}
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix(docs, clashing):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(1, 60)), ["a", "b", "c", "é", None, "tiny"][min(int(rng.integers(0, 26)) // 5, 5) if i else 5]) for i in range(4000)]
    rows += [(9000, None, "a"), (9001, "", "b"), (9002, " \n", None), (None, "x y", "a"), (5, rows[5][1], rows[5][2]), (9003, "big " * 300, "c"), (9004, "", "empty")]
    table = clashing(docs(rows))
    out = [r for r in mixing.mix_report(table).collect()]
    assert len(out) == len(rows) and Counter((r.doc_id, r.source, r.size) for r in out) == Counter((i, s, len(words(t))) for i, t, s in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = targets_of(sizes)
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and r.taken == r.size * r.copies and 0 <= r.taken <= 3 * r.size
        ratio = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r.size == 0 or math.floor(ratio) <= r.copies <= math.ceil(ratio)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes), (dict(taken), want)
    again = mixing.mix_report(docs(rows, 7)).collect()
    assert sorted(map(repr, map(tuple, again))) == sorted(map(repr, map(tuple, out)))
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == sum((Counter({(r.doc_id, r.source): r.copies}) for r in out), Counter())
    assert mixing.mix_report(docs(rows).limit(0)).count() == 0 == mixing.mix(docs(rows).limit(0)).count()


def test_mix_of_documents_without_ids(docs):
    """Rows without doc_id, and rows of one id with many texts, are documents of their own; a very long one is whole."""
    rows = [(None, f"w{i} " * (i % 9 + 1), "a") for i in range(900)] + [(1, f"v{i} x", "b") for i in range(600)] + [(2, "long " * 200_000, "c"), (3, "short one", "c")]
    keys = mixing.item_key(docs(rows).select("doc_id", "source", "text"))
    assert keys.select("at", "at2", "bytes").distinct().count() == len(rows)
    assert keys.filter("doc_id IS NULL").select(F.pmod("at", F.lit(10))).distinct().count() == 10
    out = mixing.mix_report(docs(rows)).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter((i, s, len(words(t))) for i, t, s in rows)
    copies = Counter(mixing.mix(docs(rows)).select("doc_id", "text", "source").collect())
    assert sum(len(words(r.text)) * n for r, n in copies.items()) == sum(r.taken for r in out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 50)), min_size=1, max_size=40), st.integers(0, 99))
def test_fold_keeps_words(items, seed):
    p, size = [x for x, _ in items], [float(s) for _, s in items]
    rng = np.random.default_rng(seed)
    settled = mixing.settle_large(np.array(p), np.array(size), rng, 0.2)
    out = mixing.fold(settled.tolist(), size, rng)
    assert sum(0 < x < 1 for x in out) <= 1 and all(0 <= x <= 1 for x in out)
    assert abs(sum(x * s for x, s in zip(out, size, strict=True)) - sum(x * s for x, s in items)) < 1e-6 * sum(size) + 1e-6


def test_fold_is_unbiased():
    p, size = [0.2, 0.7, 0.4, 0.9, 0.5], [5.0, 1.0, 3.0, 2.0, 8.0]
    mean = np.mean([mixing.fold(mixing.settle_large(np.array(p), np.array(size), r, 0.5).tolist(), size, r) for r in map(np.random.default_rng, range(6000))], axis=0)
    assert np.abs(mean - p).max() < 0.03


# -- op7


def brute_place(key, node, seed="knotwork"):
    if isinstance(node, shard_tree.Shard):
        return node.shard
    best = None
    for c in node.children:
        if c.weight > 0:
            label = f"shard{c.shard}" if isinstance(c, shard_tree.Shard) else c.name
            u = (int(hashlib.md5(f"{key}|{seed}|{label}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            if best is None or -math.log(u) / c.weight < best[0]:
                best = (-math.log(u) / c.weight, c)
    return brute_place(key, best[1], seed)


def test_shards(docs, clashing, monkeypatch):
    monkeypatch.setattr(shard_tree, "BLOCK_ROWS", 100)
    rows = [(i, "é" * (i % 7)) for i in range(1500)] + [(None, "a"), (None, None), (3, None), (3, "ééé"), (3, "ééé")]
    tree = shard_tree.default_tree()
    table = shard_tree.shard_documents(clashing(docs(rows)))
    out = table.collect()
    assert table.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    bigger = shard_tree.grown(tree, 16)
    for r in out:
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert r.shard == brute_place(key, tree) and r.grown_shard == brute_place(key, bigger) and r.grown_shard in (r.shard, 16) and r.law == "key"
    for s in range(16):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert shard_tree.shard_documents(docs(rows).limit(0)).count() == 0


def test_slots_of_repeated_rows_and_clashing_columns(docs, monkeypatch):
    """A third of the rows are equal, and another part has no doc_id; a very long text is only measured."""
    monkeypatch.setattr(shard_tree, "BLOCK_ROWS", 20)
    rows = [(i, f"t{i}") for i in range(300)] + [(7, "same")] * 200 + [(None, "none")] * 100 + [(None, f"n{i}") for i in range(50)] + [(1000, "x" * 3_000_000)]
    table = docs(rows, 5)
    for c in ("slot", "shard", "size", "block", "often", "lane", "n", "s", "at", "before", "extra", "__n", "__block"):
        table = table.withColumn(c, F.lit(f"my {c}"))
    out = shard_tree.shard_documents(table, extra=tuple(c for c in table.columns if c != "doc_id"))
    got = out.collect()
    assert len(got) == len(rows) and Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {"slot_", "shard_", "size_"} < set(out.columns) and all(r["slot_"] == "my slot" and r["__n"] == "my __n" and r["at"] == "my at" for r in got)
    again = shard_tree.shard_documents(docs(rows, 2)).select("doc_id", "text_crc32", "shard", "slot").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out.select("doc_id", "text_crc32", "shard", "slot").collect()))


def test_weights_move_only_below(docs):
    n = shard_tree.Node
    tree = lambda w: n("root", (n("r0", (n("r0/a", (shard_tree.Shard(0), shard_tree.Shard(1))), n("r0/b", (shard_tree.Shard(2, w),)))), n("r1", (n("r1/a", (shard_tree.Shard(3),)),))))
    rows = docs([(i, "t") for i in range(2000)])
    a, b = ({r.doc_id: r.shard for r in shard_tree.shard_documents(rows, tree(w)).collect()} for w in (1.0, 3.0))
    moved = [(a[i], b[i]) for i in a if a[i] != b[i]]
    # r0 and r0/b grow: documents come into r0 from r1, and into shard 2 from within r0.
    assert moved and all(x == 3 or y == 2 for x, y in moved) and not any(y == 3 for _, y in moved)
    share = Counter(b.values())
    assert 0.4 < share[2] / 2000 < 0.6


# -- pipeline


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from knotwork.llm import decontaminate, quality
    from knotwork.llm.common import table

    docs, stages = table(spark, sf, "documents"), corpus_pipeline.STAGES
    assert [n for n, _ in stages] == ["quality classifier", "near-duplicate removal", "benchmark decontamination", "mixing to target weights", "sharding"]
    steps = [docs]
    for _, f in stages:
        steps.append(f(spark, steps[-1], sf).cache())
    rows = [[r for r in d.collect()] for d in steps]
    assert all(d.columns == docs.columns for d in steps[:-1]) and set(docs.columns) < set(steps[-1].columns)
    space = quality.fit(docs, table(spark, sf, "labels"))
    scores = space.score(np.array([quality.terms(r.text, quality.TermBuckets()) for r in rows[0]]))
    assert sorted(r.doc_id for r, s in zip(rows[0], scores, strict=True) if s >= 0.7) == sorted(r.doc_id for r in rows[1])
    parts = brute_components([(r.doc_id, r.text) for r in rows[1]], corpus_pipeline.NEAR_PERCENT)
    assert sorted(r.doc_id for r in rows[2]) == sorted(i for i, c in parts.items() if i == c)
    items = [set(zip(*[words(r.text)[k:] for k in range(5)])) for r in table(spark, sf, "benchmark").collect()]
    own = {r.doc_id: set(zip(*[words(r.text)[k:] for k in range(5)])) for r in rows[2]}
    leaked = {i for i, s in own.items() if any(5 * len(x & s) >= 4 * len(x) for x in items)}
    assert sorted(r.doc_id for r in rows[3]) == sorted(set(own) - leaked)
    sizes, taken = Counter(), Counter()
    for r in rows[3]:
        sizes[r.source] += len(words(r.text))
    for r in rows[4]:
        taken[r.source] += len(words(r.text))
    want = targets_of(dict(sizes))
    assert {r.doc_id for r in rows[4]} <= {r.doc_id for r in rows[3]} and abs(sum(taken.values()) - sum(want.values())) < 0.1 * sum(want.values())
    assert all(r.shard == brute_place(str(r.doc_id), shard_tree.default_tree()) for r in rows[5])
    assert Counter(r.doc_id for r in rows[5]) == Counter(r.doc_id for r in rows[4])
    assert corpus_pipeline.run(spark, sf).count() == len(rows[5]) and decontaminate.SHINGLE == 5 and F is not None


def test_pipeline_stages_on_edge_cases(spark, sf):
    """Nulls in every column, empty, long and repeated rows, clashing columns; and an empty table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from knotwork.llm import quality
    from knotwork.llm.common import table

    own = table(spark, sf, "documents")
    odd = [(None, None, None, None, None), (900, None, "en", "src0", 0), (901, "", None, None, 0), (902, "word " * 200_000, "en", None, 7), (None, "a text without an id, of eight words", "de", "src1", 9)]
    odd += [odd[4], (903, "one document in two rows, one and two", "en", "src2", 1)] + [(903, "one document in two rows, one and two", "en", "src2", 1)]
    docs = own.unionByName(spark.createDataFrame(odd, own.schema))
    names = ("size", "slot", "shard", "accepted", "quality_score", "gone", "__gone", "__n", "at", "d1", "copies", "m", "kept", "component", "extra", "row")
    docs = docs.withColumns({c: F.lit(f"my {c}") for c in names}).cache()
    step, sizes = docs, []
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), sf).count() == 0
        before, step = step, f(spark, step, sf).cache()
        sizes.append((before.count(), step.count()))
        if f is not corpus_pipeline.sharding_stage:
            assert step.columns == docs.columns
            assert all(r[c] == f"my {c}" for r in step.select(*names).distinct().collect() for c in names)
        if f is corpus_pipeline.quality_stage:
            space = quality.fit(docs, table(spark, sf, "labels"))
            fine = space.score(np.zeros((1, quality.BUCKETS)))[0] >= quality.THRESHOLD
            assert step.filter("doc_id = 900 OR doc_id = 901 OR (doc_id IS NULL AND text IS NULL)").count() == (3 if fine else 0)
        if f is corpus_pipeline.near_dedup_stage:
            assert step.filter("doc_id IS NULL").count() == before.filter("doc_id IS NULL").count() and step.filter("doc_id = 903").count() == before.filter("doc_id = 903").count()
        if f is corpus_pipeline.mixing_stage:
            assert {r.source for r in step.select("source").distinct().collect()} <= {r.source for r in before.select("source").distinct().collect()}
    got = step.collect()
    assert {"size_", "slot_", "shard_"} < set(step.columns) and all(r["slot_"] == "my slot" and r["extra"] == "my extra" for r in got)
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sizes[0][1] > 100 and sizes[3][0] > 100
