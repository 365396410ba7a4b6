"""Exact top-k inner products on a bit-sliced index.

The index cuts the rows into blocks. In a block every attribute (vector component,
quantised to an integer) is kept as bit slices: bitmaps with one bit per row. A query
adds the slices of its attributes, each shifted by the set bits of the query's
weight, with full adders on whole bitmaps; the sum is again bit-sliced. The k best
rows are picked from its most significant slice downward. Only the leading slices of
each attribute take part, so the sums are lower bounds with a known error; every row
within that error of the k-th is resolved with its exact inner product. Blocks give
their k best rows a query, and a window over these few rows gives the result.

The blocks of rows and of queries are tables, and every block of queries meets every
block of rows in a join on the queries' block: nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.common import durable

#: Rows in a block of the index.
BLOCK_ROWS = 16_384
#: Queries that are broadcast at a time.
QUERY_BLOCK = 4_096
#: Leading slices of an attribute that are added up; what is below goes into the error.
SLICES = 6


def quantised(docs: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, x: floor(scale * component) of each vector; no vectors with null or non-finite components."""
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return docs.filter(whole & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def full_adder(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three bitmaps, bit by bit."""
    t = a ^ b
    return t ^ c, (a & b) | (t & c)


def add_slices(columns: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """The bit-sliced sum, least significant first, of bitmaps that each weigh 2**column."""
    out, k, zero = [], 0, np.zeros(words, np.uint64)
    columns = {w: list(v) for w, v in columns.items()}
    while columns:
        column = columns.pop(k, [])
        while len(column) > 1:
            s, carry = full_adder(column.pop(), column.pop(), column.pop() if column else zero)
            column.insert(0, s)
            columns.setdefault(k + 1, []).append(carry)
        out.append(column[0] if column else zero)
        k += 1
    return out


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def top_rows(slices: list[np.ndarray], among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """From the top slice downward: rows above the k-th largest value, rows that have it, and the value."""
    sure, tied, value = np.zeros_like(among), among, 0
    for i in reversed(range(len(slices))):
        x = sure | (tied & slices[i])
        if count(x) >= k:
            tied, value = tied & slices[i], value | 1 << i
        else:
            sure, tied = x, tied & ~slices[i]
    return sure, tied, value


def at_least(slices: list[np.ndarray], among: np.ndarray, bound: int) -> np.ndarray:
    """Rows whose bit-sliced value is >= bound."""
    if bound <= 0:
        return among
    if bound >> len(slices):
        return np.zeros_like(among)
    more, same = np.zeros_like(among), among
    for i in reversed(range(len(slices))):
        if bound >> i & 1:
            same = same & slices[i]
        else:
            more, same = more | (same & slices[i]), same & ~slices[i]
    return more | same


class BlockIndex:
    """The bit slices of a block of rows x (n, d), all of one dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, slices: int = SLICES):
        self.ids, self.x, self.n = ids, x, len(ids)
        self.words = -(-self.n // 64)
        low = int(x.min(initial=0))
        span = int(x.max(initial=0)) - low
        self.bits = max(1, span.bit_length())
        self.drop = max(0, self.bits - slices)
        self.all = self._bitmap(np.ones(self.n, bool))
        shifted = (x - low).astype(np.uint64).T  # each attribute as an unsigned number
        self.planes = [[self._bitmap((a >> np.uint64(j)) & np.uint64(1)) for j in range(self.drop, self.bits)] for a in shifted]
        self.flipped = [[p ^ self.all for p in planes] for planes in self.planes]

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.words * 64, np.uint8)
        padded[: self.n] = bits
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])

    def best(self, query: np.ndarray, k: int, but: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and exact scores of the k best rows, the places `but` left out."""
        columns: dict[int, list[np.ndarray]] = {}
        for a, w in enumerate(query.tolist()):
            # A negative weight takes the complement: -w * v = |w| * (2**bits - 1 - v) less a constant of the query.
            planes, w = (self.planes[a], w) if w > 0 else (self.flipped[a], -w)
            for i in range(w.bit_length()):
                if w >> i & 1:
                    for j, plane in enumerate(planes):
                        columns.setdefault(i + j, []).append(plane)
        among = self.all.copy()
        for r in but:
            among[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        picked = among
        if columns:
            total = add_slices(columns, self.words)
            sure, tied, value = top_rows(total, among, k)
            error = (int(np.abs(query).sum()) * ((1 << self.drop) - 1)) >> self.drop
            picked = at_least(total, among, value - error) if error else sure | tied
        at = self.rows(picked)
        score = self.x[at] @ query
        order = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at][order], score[order]


_BLOCK = "dim int, ids binary, rows binary, x binary"


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """dim, ids, rows, x: blocks of at most `size` rows (vec_id, row, x) of one dimension; ids, row numbers and vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for i, r, x in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "row", "x")), strict=True):
                block = held.setdefault(len(x), [])
                block.append((i, r, x))
                if len(block) == size:
                    yield _block(held.pop(len(x)))
        for block in held.values():
            yield _block(block)

    parts = max(1, -(-rows.count() // size))
    return durable(rows.repartition(parts).mapInArrow(run, _BLOCK).withColumn("block", F.monotonically_increasing_id()))


def _block(rows: list) -> pa.RecordBatch:
    ids, numbers = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    x = np.array([r[2] for r in rows], np.int64).reshape(len(rows), -1)
    return pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), *(pa.array([v.tobytes()]) for v in (ids, numbers, x))], ["dim", "ids", "rows", "x"])


def _check_range(vectors: DataFrame, queries: DataFrame) -> None:
    """Raise where a score may pass 64 bits, as it would wrap."""
    size = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v.cast("double")))
    most = F.coalesce(F.max(F.array_max(F.transform("x", lambda v: F.abs(v.cast("double"))))), F.lit(0.0))
    bound = (vectors.agg(most).first()[0] or 0.0) * (queries.agg(F.max(size)).first()[0] or 0.0)
    if bound >= 2.0**62:
        raise ValueError(f"inner products of these vectors may reach {bound:.3g}, beyond 64 bits")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, slices: int = SLICES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products, ties to the smaller vec_id.

    vectors and queries are as `quantised` gives them. Where both have a column `row`, a
    query is every row of queries, and all rows but its own are candidates, those that
    repeat its vec_id too; otherwise equal queries are one, and all rows but those with
    its vec_id are candidates. A vector of another dimension than the query's is none.
    Rows that repeat a vec_id are candidates of their own. Fewer than k candidates give
    all there are; empty tables give an empty result. Vectors whose inner products may
    pass 64 bits raise a ValueError. Blocks of rows are copied once for each block of
    QUERY_BLOCK queries.
    """
    by_row = "row" in vectors.columns and "row" in queries.columns
    if not by_row:
        vectors, queries = (t.select("vec_id", "x", F.col("vec_id").alias("row")) for t in (vectors, queries.select("vec_id", "x").distinct()))
    _check_range(vectors, queries)
    index, asked = _packed(vectors, block_rows), _packed(queries, QUERY_BLOCK)
    n = asked.select("block").distinct().count() * index.count()
    asked = asked.select("dim", F.col("block").alias("asked"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("x").alias("q_x"))
    every = asked.groupBy("dim").agg(F.collect_list("asked").alias("asked"))  # as many numbers as there are blocks of queries
    pairs = index.join(F.broadcast(every), "dim").withColumn("asked", F.explode("asked")).join(asked.drop("dim"), "asked")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, rows, q_ids, q_rows = (np.frombuffer(r[c], np.int64) for c in ("ids", "rows", "q_ids", "q_rows"))
                x, q_x = (np.frombuffer(r[c], np.int64).reshape(-1, r["dim"]) if r["dim"] else np.zeros((len(i), 0), np.int64) for c, i in (("x", ids), ("q_x", q_ids)))
                at = BlockIndex(ids, x, slices)
                order = np.argsort(rows, kind="stable")
                lo, hi = (np.searchsorted(rows[order], q_rows, side) for side in ("left", "right"))
                best = [at.best(v, k, order[a:b]) for v, a, b in zip(q_x, lo, hi, strict=True)]
                if best:
                    many = [len(i) for i, _ in best]
                    number = (r["asked"] << 20) + np.arange(len(q_ids))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(number, many), pa.int64()), pa.array(np.repeat(q_ids, many), pa.int64()),
                        pa.array(np.concatenate([i for i, _ in best]), pa.int64()), pa.array(np.concatenate([s for _, s in best]), pa.int64()),
                    ], ["number", "query_id", "vec_id", "score"])

    found = pairs.repartition(max(1, n)).mapInArrow(search, "number long, query_id long, vec_id long, score long")
    ranked = Window.partitionBy("number").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_every(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The vectors whose id is divisible by `every` as queries against all vectors, by row; edge cases as in top_k."""
    rows = durable(quantised(vectors).withColumn("row", F.monotonically_increasing_id()))
    return top_k(rows, rows.filter(F.col("vec_id") % every == 0), k)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
