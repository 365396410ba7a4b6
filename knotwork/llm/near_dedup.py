"""Near-duplicate documents: a multi-index Hamming join of MinHash signatures.

A signature has CODES b-bit codes, each the low bits of a minimum over the document's
shingles. For a pair at the similarity threshold the number of codes that differ is
binomial; the radius is such that fewer than one pair in a million differs in more. The
codes are split into chunks. By the pigeonhole principle two signatures within the radius
agree on some chunk up to its allowance of errors (one or none), and the allowed
errors are enumerated as chunks with that many codes left out. So the join on the
remaining codes finds every pair within the radius. Links are confirmed on the full
shingle sets.

Copies (equal word sequences) are one class from the start. A bucket of the join never
expands into pairs. A shingle that only one class has can be in no intersection, so a
class's other shingles bound its similarity to anything; classes that this bound
excludes leave their buckets (heavily edited copies and documents that share no more
than a passage). The members left are held against the one with the smallest share of
such shingles, which of a group of copies is the original or close to it, and the
links give components. Only where a bucket then still spans several components, the
members outside its center's are compared to the rest in blocks; pairs of different
components within the radius, and within the bound, are confirmed in the block, and
only links that join components leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import WordHashes, bounded, durable, fresh, grouped, mix64, shingle_hashes, words_of
from knotwork.llm.components import connected_components

#: Linked if 100 * intersection >= PERCENT * union, where no other percentage is given.
PERCENT = 85
CODES = 96
CHUNKS = 24
#: Odds that a pair at the threshold lies beyond the radius.
MISS = 1e-6
#: Members of a bucket that are compared in one block, and shingles that their sets hold together, about.
BLOCK, BLOCK_SHINGLES = 512, 4_000_000


def radius(codes: int = CODES, similarity: float = PERCENT / 100, miss: float = MISS) -> int:
    """Differing codes that all but the share `miss` of pairs at the threshold keep within."""
    p, beyond = 1 - similarity, 0.0
    for k in range(codes, -1, -1):
        beyond += comb(codes, k) * p**k * (1 - p) ** (codes - k)
        if beyond > miss:
            return k
    return 0


RADIUS = radius()


def radius_for(percent: int) -> int:
    return radius(similarity=percent / 100)


def chunk_plan(codes: int = CODES, chunks: int = CHUNKS, within: int = RADIUS) -> list[tuple[int, ...]]:
    """The code positions of every key.

    With within = q * chunks + r, r + 1 chunks allow q errors and the others q - 1:
    signatures that break every allowance differ in at least within + 1 codes.
    """
    q, r = divmod(within, chunks)
    plan = []
    for c, part in enumerate(np.array_split(np.arange(codes), chunks)):
        errors = q if c <= r else q - 1
        if errors >= 0:
            if errors >= len(part):
                raise ValueError("the radius needs larger chunks")
            plan += combinations(part.tolist(), len(part) - errors)
    return plan


_RNG = np.random.default_rng(2024)
_MASKS = _RNG.integers(0, 1 << 32, CODES, np.uint64).astype(np.uint32)
_FACTORS = _RNG.integers(0, 1 << 31, CODES, np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The codes (n, CODES) of non-empty shingle sets."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), CODES), np.uint16)
    for j in range(CODES):
        out[:, j] = np.minimum.reduceat((x ^ _MASKS[j]) * _FACTORS[j], starts) & np.uint32(0xFFFF)
    return out


def bucket_keys(codes: np.ndarray, plan: list[tuple[int, ...]]) -> np.ndarray:
    """A 64-bit key for each signature and entry of the plan."""
    wide = codes.astype(np.uint64)
    out = np.empty((len(codes), len(plan)), np.uint64)
    for i, at in enumerate(plan):
        h = np.full(len(codes), i + 1, np.uint64)
        for j in at:
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + wide[:, j])
        out[:, i] = h
    return out.view(np.int64)


def _digests(words: list[list[bytes]]) -> np.ndarray:
    """128 bits of every word sequence, as two columns."""
    return np.array([divmod(xxhash.xxh3_128_intdigest(b" ".join(w)), 1 << 64) for w in words], np.uint64).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        words = [words_of(t) for t in b.column("text").to_pylist()]
        digests = _digests(words)
        sets = [np.unique(shingle_hashes(w, hashes)) for w in words]
        full = [i for i, s in enumerate(sets) if len(s)]
        sig: list[bytes | None] = [None] * len(sets)
        if full:
            for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                sig[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary())],
            ["doc_id", "d1", "d2", "n_shingles", "sig"],
        )


def _emit_keys(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    plan = chunk_plan(within=radius_for(percent))
    for b in batches:
        keys = bucket_keys(np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, CODES), plan)
        rid = np.repeat(b.column("rid").to_numpy(), keys.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(rid)], ["key", "rid"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for b in batches:
        words = [words_of(t) for t in b.column("text").to_pylist()]
        digests = _digests(words)
        sets = [np.unique(shingle_hashes(w, hashes)).view(np.int64) for w in words]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        shingles = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digests[:, 0]), pa.array(digests[:, 1]), shingles], ["doc_id", "d1", "d2", "shingles"])


def _close(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures lie within the radius."""
    within = radius_for(percent)
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, CODES) for c in ("sig_a", "sig_b"))
            yield b.select(["a", "b"]).filter(pa.array((x != y).sum(1) <= within))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    return [flat[i:j] for i, j in zip(ends, ends[1:], strict=False)]


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that the full sets link."""
    for b in batches:
        keep = []
        for x, y in zip(_arrays(b.column("set_a")), _arrays(b.column("set_b")), strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _candidates(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The members of each group (key, bi, bj) that have a pair to confirm, with their partners.

    Pairs are of different components, within the radius, and can be linked by what they
    share with any document. side is 0 for members of the block that is held against
    the others, 1 for the others; a block alone (bj = -1) has all at side 0. A pair that
    meets in several buckets is given by that of the first entry of the plan. A pair is
    with one of its members only.
    """
    within = radius_for(percent)
    plan = chunk_plan(within=within)
    for group, t in grouped(batches, _GROUP):
        side, rid, comp, n, common = (t.column(c).to_numpy() for c in ("side", "rid", "comp", "n", "common"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, CODES)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        partners: dict[int, np.ndarray] = {}
        for k, i in enumerate(left):
            j = left[k + 1 :] if group[2] < 0 else right
            most = np.minimum(common[j], common[i])
            j = j[(comp[j] != comp[i]) & (100 * most >= percent * (n[j] + n[i] - most))]
            j = j[(sig[j] != sig[i]).sum(1) <= within]
            if len(j):
                same = sig[j] == sig[i]
                first = np.array([same[:, at].all(1) for at in plan]).argmax(0)
                j = j[bucket_keys(sig[i : i + 1], plan)[0, first] == group[0]]
                if len(j):
                    partners[int(i)] = j
        if partners:
            some = np.unique(np.concatenate([np.fromiter(partners, np.int64, len(partners)), *partners.values()]))
            keys = [pa.array(np.full(len(some), x), pa.int64()) for x in group]
            found = pa.array([rid[partners[i]] if i in partners else None for i in some.tolist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*keys, pa.array(rid[some]), pa.array(comp[some]), found], [*_GROUP, "rid", "comp", "partners"])


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links that join the components of each group's members, as many as it takes: pairs that the full sets link.

    A member's set is held against those of all its partners at once; a pair whose
    components have been joined already is left out, as its link would change nothing.
    """
    for _, t in grouped(batches, _GROUP):
        rid, comp = t.column("rid").to_numpy().tolist(), t.column("comp").to_numpy().tolist()
        place = {r: i for i, r in enumerate(rid)}
        sets = t.column("shingles").combine_chunks()
        sets = _arrays(sets.combine_chunks() if isinstance(sets, pa.ChunkedArray) else sets)
        words, at = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([len(x) for x in sets])
        sets = np.split(at, ends[:-1])
        size = np.array([len(x) for x in sets])
        top = {c: c for c in comp}

        def root(c: int) -> int:
            while top[c] != c:
                top[c] = c = top[top[c]]
            return c

        out, mark = [], np.zeros(len(words), np.int64)
        for i, found in enumerate(t.column("partners").to_pylist()):
            j = np.array([place[r] for r in found or () if root(comp[place[r]]) != root(comp[i])], np.int64)
            j = j[100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i])]
            if not len(j):
                continue
            mark[sets[i]] = 1
            both = np.add.reduceat(mark[np.concatenate([sets[x] for x in j])], np.cumsum([0, *size[j][:-1]]))
            mark[sets[i]] = 0
            for x in j[100 * both >= percent * (size[i] + size[j] - both)].tolist():
                a, b = root(comp[i]), root(comp[x])
                if a != b:
                    top[max(a, b)] = min(a, b)
                    out.append((min(rid[i], rid[x]), max(rid[i], rid[x])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])


_PAIRS = "a long, b long"
_GROUP = ("key", "bi", "bj")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("rid").alias("b"), F.col("shingles").alias("set_b"))
    return durable(pairs.join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b").mapInArrow(bounded(partial(_confirm, percent=percent)), _PAIRS))


def _near_by_signature(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    a = classes.select(F.col("rid").alias("a"), F.col("sig").alias("sig_a"))
    b = classes.select(F.col("rid").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "sig_a", "sig_b").mapInArrow(bounded(partial(_close, percent=percent)), _PAIRS)


def _across(members: DataFrame, comps: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components that buckets span; members: key, rid, center, n, common.

    Blocks of a bucket are compared by signature first. Only members with a pair to
    confirm get their sets, and a group's pairs are confirmed where its sets are, so no
    pair is a row.
    """
    own = comps.select(F.col("node").alias("rid"), F.col("component").alias("comp"))
    first = comps.select(F.col("node").alias("center"), F.col("component").alias("of_center"))
    rows = members.join(own, "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    rows = rows.join(first, "center", "left").withColumn("of_center", F.coalesce("of_center", "center"))
    rows = rows.withColumn("out", (F.col("comp") != F.col("of_center")).cast("int"))
    spans = rows.groupBy("key").agg(F.sum("out").alias("n_out"), F.sum(1 - F.col("out")).alias("n_in"), F.avg("n").alias("mean_n")).filter(F.col("n_out") > 0)
    rows = rows.join(spans, "key").select("key", "rid", "comp", "n", "common", "out", "n_out", "n_in", "mean_n")
    # The members of a bucket have sets of much the same size, so the mean bounds a block's bytes too.
    block = F.greatest(F.least(F.lit(BLOCK), F.floor(BLOCK_SHINGLES / F.col("mean_n"))), F.lit(2))
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / block), F.lit(1)).cast("int")
    rows = rows.withColumns({"outs": blocks("n_out"), "ins": blocks("n_in")})
    mine = F.pmod(F.xxhash64("rid"), F.when(F.col("out") == 1, F.col("outs")).otherwise(F.col("ins"))).cast("int")
    rows = rows.withColumn("mine", mine)
    # Groups: an outer block alone (bj = -1), two outer blocks, an outer and an inner block (bj counted after the outer ones).
    at = lambda bi, bj, side: F.struct(bi.cast("int").alias("bi"), bj.cast("int").alias("bj"), side.cast("int").alias("side"))
    one, zero = F.lit(1), F.lit(0)
    outer = F.concat(
        F.array(at(F.col("mine"), F.lit(-1), zero)),
        F.transform(F.filter(F.sequence(zero, F.col("outs") - 1), lambda j: j > F.col("mine")), lambda j: at(F.col("mine"), j, zero)),
        F.transform(F.filter(F.sequence(zero, F.col("outs") - 1), lambda i: i < F.col("mine")), lambda i: at(i, F.col("mine"), one)),
        F.transform(F.sequence(zero, F.col("ins") - 1), lambda j: at(F.col("mine"), F.col("outs") + j, zero)),
    )
    inner = F.transform(F.sequence(zero, F.col("outs") - 1), lambda i: at(i, F.col("outs") + F.col("mine"), one))
    rows = rows.withColumn("g", F.explode(F.when(F.col("out") == 1, outer).otherwise(inner)))
    rows = rows.join(classes.select("rid", "sig"), "rid").select("key", "g.bi", "g.bj", "g.side", "rid", "comp", "n", "common", "sig")
    near = rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    near = durable(near.mapInArrow(bounded(partial(_candidates, percent=percent)), "key long, bi long, bj long, rid long, comp long, partners array<long>"))
    held = near.join(sets, "rid").select(*_GROUP, "rid", "comp", "partners", "shingles").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return durable(held.mapInArrow(bounded(partial(_verify, percent=percent)), _PAIRS))


def _linkable(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """key, rid, center, n, common: members that may be linked, in buckets that keep two or more.

    n counts a class's shingles and common those that another class in a bucket has too.
    A bucket's center is the member with the smallest share of others.
    """
    once = sets.select("rid", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("rid").alias("rid"))
    own = once.filter(F.col("c") == 1).groupBy("rid").agg(F.count(F.lit(1)).alias("own"))
    sizes = sets.select("rid", F.size("shingles").cast("long").alias("n")).join(own, "rid", "left")
    sizes = sizes.withColumn("common", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    sizes = durable(sizes.filter(100 * F.col("common") >= percent * F.col("n")))
    members = durable(members.join(sizes, "rid"))
    center = F.min(F.struct((1 - F.col("common") / F.col("n")).alias("share"), "rid"))["rid"]
    centers = members.groupBy("key").agg(center.alias("center"), F.min("rid").alias("lo"), F.max("rid").alias("hi"))
    return durable(members.join(centers.filter(F.col("lo") != F.col("hi")).select("key", "center"), "key"))


def link_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Two documents are linked from a similarity of `percent` in a hundred on, equal
    similarity included; a pair at just that similarity is beyond the radius, and lost,
    with odds of MISS. Sets hold 64-bit hashes of shingles.

    A text without words (or null) has no shingles and is linked with nothing. Rows of
    one doc_id are one document, linked by each of its texts; every row has the
    n_shingles of its own text. Repeated rows give repeated results. A null doc_id is
    linked with nothing: its component_id is null and it is kept. A text is held whole,
    one at a time, with a set of 8 bytes a word. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = durable(picked.mapInArrow(bounded(_sign), "doc_id long, d1 long, d2 long, n_shingles long, sig binary"))
    known = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # A class has a number of its own (rid), as a doc_id can have several texts; doc_id is its smallest.
    classes = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"))
    classes = durable(classes.withColumn("rid", F.monotonically_increasing_id()))

    buckets = classes.select("rid", "sig").mapInArrow(bounded(partial(_emit_keys, percent=percent), 2000), "key long, rid long")
    shared = buckets.groupBy("key").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).filter(F.col("lo") != F.col("hi"))
    members = durable(buckets.join(shared.select("key"), "key"))
    wanted = classes.select("rid", "doc_id", "d1", "d2").join(members.select("rid").distinct(), "rid", "left_semi")
    texts = picked.join(wanted.select("doc_id"), "doc_id", "left_semi")
    sets = texts.mapInArrow(bounded(_sets), "doc_id long, d1 long, d2 long, shingles array<long>")
    sets = durable(sets.join(wanted, ["doc_id", "d1", "d2"]).select("rid", "shingles"))
    if sets.count() > sets.select("rid").distinct().count():  # rows that repeat a doc_id and its text
        sets = durable(sets.groupBy("rid").agg(F.first("shingles").alias("shingles")))
    members = _linkable(members, sets, percent)

    star = members.filter(F.col("rid") != F.col("center"))
    star = star.select(F.least("center", "rid").alias("a"), F.greatest("center", "rid").alias("b")).distinct()
    star = durable(_near_by_signature(star, classes, percent))
    links = _confirmed(star, sets, percent)
    comps = connected_components(links)
    more = _across(members, comps, classes, sets, percent)
    # Copies of one text are linked through their class; a doc_id with several texts links their classes.
    own = known.select("d1", "d2", F.col("doc_id").alias("b")).join(classes.select("d1", "d2", F.col("doc_id").alias("a")), ["d1", "d2"]).select("a", "b")
    a, b = (classes.select(F.col("rid").alias(c), F.col("doc_id").alias(f"doc_{c}")) for c in "ab")
    linked = links.unionByName(more).join(a, "a").join(b, "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    comps = connected_components(linked.unionByName(own))
    out = signed.select("doc_id", "n_shingles").join(comps.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that are kept: of each component the document of the smallest doc_id.

    Columns stay as they were. Rows without doc_id stay, and all rows of a doc_id that
    is kept; edge cases are otherwise as in link_documents.
    """
    gone = fresh(docs.columns, "gone")
    out = link_documents(docs.select("doc_id", "text"), percent).filter(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(out, F.col("doc_id") == F.col(gone), "left_anti")


#: Exact similarities of all pairs that share a shingle, and components, at 85 in a hundred.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (
  SELECT i, doc_id, array_to_string(w, ' ') AS whole, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' '))) END AS s FROM w),
c AS (SELECT whole, min(i) AS c, any_value(s) AS s FROM t WHERE doc_id IS NOT NULL AND len(s) > 0 GROUP BY whole),
m AS (SELECT DISTINCT c.c, t.doc_id FROM t JOIN c ON t.whole = c.whole WHERE t.doc_id IS NOT NULL),
x AS (SELECT c, len(s) AS n, unnest(s) AS s FROM c),
l AS (
  SELECT a.c AS a, b.c AS b FROM x a JOIN x b ON a.s = b.s AND a.c < b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l UNION ALL SELECT p.c, q.c FROM m p JOIN m q ON p.doc_id = q.doc_id AND p.c <> q.c),
r AS (SELECT c, c AS o FROM c UNION SELECT r.c, e.b FROM r JOIN e ON r.o = e.a),
k AS (SELECT m.doc_id, min(o.doc_id) AS component FROM m JOIN r ON m.c = r.c JOIN m o ON r.o = o.c GROUP BY m.doc_id)
SELECT t.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component, t.doc_id) AS component_id, coalesce(component, t.doc_id) IS NOT DISTINCT FROM t.doc_id AS kept
FROM t LEFT JOIN k ON t.doc_id = k.doc_id
"""
