"""Benchmark decontamination: short test items inside long documents.

An item is found in a document that contains at least a share t of its distinct
shingles. Items are partitioned by size. In the partition of items up to u shingles
the index keeps a bottom-k MinHash sketch of every item, its k = u - ceil(t * u) + 1
smallest shingle hashes: a document that lacks all k lacks more than the share 1 - t,
so a shingle of the document in the sketch is necessary for containment t, and the
search loses nothing. (A sketch of the document's side would: a test item of 30
shingles has a Jaccard similarity of about 0.002 to a document of 20,000.)

One pass over the documents holds their shingles against a bitmap of the sketches,
which is broadcast and never larger than MOST_BITS; what it lets through is joined to
the sketches. More items than the bitmap tells apart make more rows to join, but lose
nothing. Candidates are verified on the shingles themselves, not their hashes: each
candidate text comes to a task once, and its items one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import WordHashes, bounded, durable, shingle_hashes, words_of

SHINGLE = 5
#: Share of an item's shingles that a document must contain.
CONTAINMENT = Fraction(4, 5)
#: Bits of the bitmap for each hash of a sketch, about, and at most in all (as powers of two).
BITS_EACH, MOST_BITS = 8, 26


def shingles(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def needed(n: int, share: Fraction) -> int:
    """The least number of n shingles that is at least the share."""
    return -(-share.numerator * n // share.denominator)


def sketch(words: list[bytes], hashes: WordHashes, share: Fraction) -> np.ndarray:
    """The smallest distinct shingle hashes of an item, as many as its size partition needs."""
    distinct = np.unique(shingle_hashes(words, hashes, min(SHINGLE, len(words))))
    most = (1 << len(distinct).bit_length()) - 1
    return distinct[: most - needed(most, share) + 1]


def keyed(rows: DataFrame, name: str) -> DataFrame:
    """The texts that are not null, with a 128-bit key (name1, name2)."""
    return rows.filter(F.col("text").isNotNull()).select(F.xxhash64("text").alias(f"{name}1"), F.xxhash64(F.lit(1), "text").alias(f"{name}2"), "text")


def _sketches(items: DataFrame, share: Fraction) -> DataFrame:
    """i1, i2, size, hash: the sketch of every item text; size is the number of words in a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for i in range(b.num_rows):
                words = words_of(b.column("text")[i].as_py())
                if words:
                    h = sketch(words, hashes, share).view(np.int64)
                    same = lambda x: pa.array(np.full(len(h), x, np.int64))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(b.column("i1")[i].as_py()), same(b.column("i2")[i].as_py()), same(min(SHINGLE, len(words))), pa.array(h)], ["i1", "i2", "size", "hash"])

    return keyed(items, "i").dropDuplicates(["i1", "i2"]).mapInArrow(bounded(run), "i1 long, i2 long, size long, hash long")


def _bitmap(sketches: DataFrame, most_bits: int) -> tuple[np.ndarray, int]:
    """A bitmap of the low bits of the sketches' hashes, and how many these are; the driver gets its words, not the hashes."""
    bits = min(most_bits, max(6, sketches.count().bit_length() + BITS_EACH))
    place = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    word = F.shiftright(place, 6).alias("word")
    words = sketches.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, CAST(hash & 63 AS INT))")).alias("set")).collect()
    out = np.zeros(1 << bits - 6, np.uint64)
    for r in words:
        out[r.word] = np.uint64(r.set & (1 << 64) - 1)
    return out, bits


def _hits(docs: DataFrame, sizes: list[int], bitmap: np.ndarray, bits: int) -> DataFrame:
    """d1, d2, hash: the shingles of every text that the bitmap lets through."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, mask = WordHashes(), np.uint64((1 << bits) - 1)
        for b in batches:
            found = []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                parts = [shingle_hashes(words, hashes, size) for size in sizes if len(words) >= size]
                h = np.concatenate(parts) if parts else np.empty(0, np.uint64)
                low = h & mask
                found.append(np.unique(h[(sent.value[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) == 1]).view(np.int64))
            n = [len(x) for x in found]
            if sum(n):
                yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(b.column(c).to_numpy(), n)) for c in ("d1", "d2")), pa.array(np.concatenate(found))], ["d1", "d2", "hash"])

    return keyed(docs, "d").mapInArrow(bounded(run), "d1 long, d2 long, hash long")


class Text:
    """A document's shingles, looked up by hash and compared by word; arrays of 16 bytes a word beside its words."""

    def __init__(self, text: str, hashes: WordHashes):
        self.words, self.hashes = words_of(text), hashes
        self.index: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def holds(self, parts: list[tuple[bytes, ...]], size: int) -> int:
        """How many of the distinct shingles the document has."""
        if len(self.words) < size:
            return 0
        if size not in self.index:
            h = shingle_hashes(self.words, self.hashes, size)
            order = np.argsort(h, kind="stable")
            self.index[size] = h[order], order
        h, order = self.index[size]
        wanted = np.array([shingle_hashes(list(p), self.hashes, size)[0] for p in parts], np.uint64)
        lo, hi = np.searchsorted(h, wanted, "left"), np.searchsorted(h, wanted, "right")
        return sum(any(tuple(self.words[at : at + size]) == p for at in order[a:b]) for p, a, b in zip(parts, lo.tolist(), hi.tolist(), strict=True))


def contained(docs: DataFrame, items: DataFrame, share: Fraction = CONTAINMENT, most_bits: int = MOST_BITS) -> DataFrame:
    """d1, d2, i1, i2, n_item, n_shared: every pair of a text and an item text that it contains, by their keys."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    items = items.select(F.col("text").cast("string").alias("text"))
    sketches = durable(_sketches(items, share))
    sizes = sorted(r["size"] for r in sketches.select("size").distinct().collect())
    hits = _hits(texts, sizes, *_bitmap(sketches, most_bits))
    pairs = durable(hits.join(sketches.select("hash", "i1", "i2"), "hash").select("d1", "d2", "i1", "i2").distinct())
    wanted = keyed(texts, "d").join(pairs.select("d1", "d2").distinct(), ["d1", "d2"], "left_semi").dropDuplicates(["d1", "d2"])
    none = F.lit(None).cast("long")
    asked = pairs.join(keyed(items, "i").dropDuplicates(["i1", "i2"]), ["i1", "i2"])
    # The text of a document, and after it its items.
    rows = wanted.select("d1", "d2", none.alias("i1"), none.alias("i2"), "text").unionByName(asked.select("d1", "d2", "i1", "i2", "text"))
    rows = rows.repartition("d1", "d2").sortWithinPartitions("d1", "d2", F.col("i1").asc_nulls_first(), "i2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, own = WordHashes(), None
        for b in batches:
            out = []
            for d1, d2, i1, i2, text in zip(*(b.column(c).to_pylist() for c in ("d1", "d2", "i1", "i2", "text")), strict=True):
                if i1 is None:
                    own = Text(text, hashes)
                    continue
                words = words_of(text)
                size = min(SHINGLE, len(words))
                parts = list(dict.fromkeys(shingles(words, size)))
                shared = own.holds(parts, size)
                if shared >= needed(len(parts), share):
                    out.append((d1, d2, i1, i2, len(parts), shared))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["d1", "d2", "i1", "i2", "n_item", "n_shared"])

    return durable(rows.mapInArrow(bounded(run), "d1 long, d2 long, i1 long, i2 long, n_item long, n_shared long"))


def leaks(docs: DataFrame, items: DataFrame, share: Fraction = CONTAINMENT, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: every pair of a document and an item it contains.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. An item of fewer than five words
    is one shingle of all its words; a null or empty text contains nothing and is
    contained nowhere. An item of which just the share is contained counts. Null ids
    stay null; repeated documents and items each give their pairs; a text of any length
    is searched whole; empty tables give an empty result; other columns are ignored.
    """
    key = lambda rows, id_, name: rows.select(F.col(id_).cast("long").alias(id_), *[h.alias(f"{name}{i}") for i, h in enumerate(_key(), 1)])
    out = contained(docs, items, share, most_bits).join(key(docs, "doc_id", "d"), ["d1", "d2"]).join(key(items, "item_id", "i"), ["i1", "i2"])
    return out.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def _key() -> tuple:
    text = F.col("text").cast("string")
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def without_leaks(docs: DataFrame, items: DataFrame, share: Fraction = CONTAINMENT, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of docs that contain no item; columns as they were, edge cases as in leaks."""
    found = contained(docs, items, share, most_bits).select("d1", "d2").distinct()
    text = docs["text"].cast("string")
    same = (F.xxhash64(text) == found["d1"]) & (F.xxhash64(F.lit(1), text) == found["d2"])
    return docs.join(found, same, "left_anti")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda s: s <> '') AS words FROM documents WHERE text IS NOT NULL),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda s: s <> '') AS words FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
bs AS (SELECT DISTINCT item_id, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT item_id, words, unnest(range(1, len(words) - 3)) AS i FROM b WHERE len(words) >= 5)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM p JOIN n USING (item_id) WHERE 5 * n_shared >= 4 * n_item
"""
