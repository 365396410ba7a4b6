"""What the training-data operators share: tables, durable results, words, hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from knotwork.durable import durable as durable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a Python function gets at a time: long texts stay few.
SLICE = 500

Batches = Iterator[pa.RecordBatch]


def bounded(work: Callable[[Batches], Batches], rows: int = SLICE) -> Callable[[Batches], Batches]:
    """work on slices of the batches; a worker gives its free memory back to the system when it is done.

    Workers outlive a stage, so what they hold would count against the next one.
    """

    def run(batches: Batches) -> Batches:
        try:
            yield from work(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def fresh(columns: list[str], name: str) -> str:
    """name, with as many underscores as it takes to be none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def grouped(batches: Batches, keys: tuple[str, ...]) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """The rows of each key, from batches in which equal (whole-number) keys follow each other."""
    held: list[pa.RecordBatch] = []
    group: tuple[int, ...] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        ids = np.stack([b.column(c).to_numpy() for c in keys], 1)
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), len(ids)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            mine = tuple(ids[s].tolist())
            if mine != group and held:
                yield group, pa.Table.from_batches(held)
                held = []
            group = mine
            held.append(b.slice(s, e - s))
    if held:
        yield group, pa.Table.from_batches(held)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bound."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = h
        return h


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased.

    bytes.split() and bytes.lower() know just these separators and letters.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: list[bytes], hashes: WordHashes, size: int = 5) -> np.ndarray:
    """Hashes of all runs of `size` words in order; fewer words make one run; no words none."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - size + 1)
    h = np.full(n, min(size, len(w)), np.uint64)
    for i in range(min(size, len(w))):
        h = h * _FACTOR + w[i : i + n]
    return mix64(h)


def shingle_set(text: str | None, hashes: WordHashes, size: int = 5) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(words_of(text), hashes, size))
