"""Quality classifier: nearest-neighbour voting in a latent semantic space.

A document is a bag of hashed terms: its words, their endings, their shapes ("THE!!" is
"A!"), words that follow themselves or stand in lines it has already had, and how many
these are, how fresh its words are and how many they are, each as the term of a range. Term
weights are log(1 + frequency in a hundred words) * idf, the document frequencies
counted over all documents. The latent space is the truncated singular value
decomposition of a bounded sample of labelled documents; their vectors are broadcast.
Every document is projected, its exact cosine with every labelled vector is computed
in blocks, and the labels of the nearest vote with their similarity.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.durable import driver_trimmed
from knotwork.llm.common import bounded, fresh

#: Labelled documents of either label that are fitted on at most: the bound of all that is broadcast.
SAMPLE_PER_LABEL = 2_500
BUCKETS = 1_024
RANK = 64
NEIGHBOURS = 15
THRESHOLD = 0.7
_CHUNK = 256

#: Frequency of a word, an ending and a shape in a hundred words counts so much; a short text's counts less.
FIELDS = (0.1, 0.1, 1.0)
SHORT = 30
#: Weight of a range's term.
RANGE = 30.0


def shape(word: str) -> str:
    """The word with runs of capitals as A, other letters a, a capitalised word Aa, digits 0, and runs of a mark as one."""
    out = []
    for c in word:
        s = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out[:8])


class TermBuckets(dict):
    """word -> buckets of the word, its ending and its shape as one number, remembered up to a bound."""

    LIMIT = 200_000

    def __missing__(self, word: str) -> int:
        terms = (bucket("w:" + word.lower()) * BUCKETS + bucket("e:" + word[-3:].lower())) * BUCKETS + bucket("s:" + shape(word))
        if len(self) < self.LIMIT:
            self[word] = terms
        return terms


def bucket(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass")) % BUCKETS


def terms(text: str | None, buckets: TermBuckets) -> np.ndarray:
    """log(1 + frequency) by bucket; zeros for a text without words."""
    out = np.zeros(BUCKETS)
    order = text.split() if text else []
    if not order:
        return out
    words, n = Counter(order), len(order)
    at = np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))
    counts = np.fromiter(words.values(), float, len(words)) * (100 / (n + SHORT))
    for j, weight in enumerate(FIELDS):
        out += np.bincount(at // BUCKETS ** (2 - j) % BUCKETS, counts * weight, BUCKETS)
    lines, again = text.split("\n"), 0.0
    if len(set(lines)) < len(lines):  # a line without words repeats none
        again = sum((k - 1) * len(x.split()) for x, k in Counter(lines).items() if k > 1) / n
    # A text of n words has fewer distinct ones the longer it is; the power law is the usual rule.
    new = min(1.5, len(words) / n * (n / 10) ** 0.2)
    # Words that follow themselves.
    run = sum(map(eq, order, islice(order, 1, None))) / n
    out[bucket("again")] += 100 * again
    out[bucket("run")] += 100 * run
    for term in (f"again:{round(8 * again)}", f"run:{round(8 * run)}", f"new:{round(8 * new)}", f"size:{min(8, n.bit_length())}"):
        out[bucket(term)] += RANGE
    return np.log1p(out)


@dataclass
class Space:
    """idf, the projection, and the labelled vectors."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    #: What a vote counts by label: the sample may hold another share of a label than the table.
    heft: np.ndarray

    @property
    def prior(self) -> float:
        h = self.heft[self.labels.astype(int)]
        return float((h * self.labels).sum() / h.sum())

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, idf: np.ndarray, heft: tuple[float, float] = (1.0, 1.0), rank: int = RANK) -> Space:
        """x is overwritten, as the driver has room for it once."""
        for at in range(0, len(x), _CHUNK):
            x[at : at + _CHUNK] = normalised(x[at : at + _CHUNK] * idf)
        values, vectors = np.linalg.eigh(x.T @ x)
        basis = vectors[:, ::-1][:, :rank].astype(np.float32)
        return cls(idf.astype(np.float32), basis, normalised(x.astype(np.float32) @ basis), labels.astype(np.float32), np.array(heft))

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """Exact cosines of rows of term weights with all labelled vectors, to five digits, so that blocks of any size agree."""
        v = normalised(normalised(x.astype(np.float32) * self.idf) @ self.basis)
        return np.round(v @ self.vectors.T, 5)

    def score(self, x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """The vote of the k nearest, and of all that are as near as the k-th, weighted by the 8th power of their cosine.

        The prior where nothing is alike.
        """
        if not len(self.labels):
            return np.full(len(x), 0.5)
        heft = self.heft[self.labels.astype(int)]
        ballot = np.stack([heft * self.labels, heft], 1)
        out = np.empty(len(x))
        for at in range(0, len(x), _CHUNK):
            cosine = self.cosines(x[at : at + _CHUNK])
            last = max(0, cosine.shape[1] - k)
            least = np.partition(cosine, last, axis=1)[:, last : last + 1]
            w = np.where(cosine >= np.maximum(least, 0), cosine, 0).astype(float)
            for _ in range(3):
                w *= w
            votes = w @ ballot
            total = votes[:, 1]
            out[at : at + _CHUNK] = np.clip(np.divide(votes[:, 0], total, out=np.full(len(total), self.prior), where=total > 0), 0, 1)
        return out


def normalised(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def fold_of(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 4


def training_labels(labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> tuple[dict[int, int], tuple[float, float]]:
    """doc_id -> quality of at most per_label rows of either label outside the held-out fold, by a hash of the id.

    With it, by label, how many labelled rows one of the sample stands for. A document
    that is labelled 0 and 1 counts as 0.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold_of(F.col("doc_id")) != 2))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    sizes = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    picked: dict[int, int] = {}
    for q in (0, 1):
        picked |= {r.doc_id: q for r in known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).collect()}
    return picked, tuple(max(1.0, sizes.get(q, 0) / per_label) for q in (0, 1))


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many of all documents each bucket has a term, and last their number; tasks count, and the sums are BUCKETS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = TermBuckets(), np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                total[:-1] += terms(t, buckets) > 0
            total[-1] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(total)], ["bucket", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    out = np.zeros(BUCKETS + 1)
    for r in texts.mapInArrow(bounded(run, _CHUNK), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Space:
    """The space of a bounded sample of labelled documents, with the document frequencies of all.

    Of a doc_id with several texts the one with the smallest hash is the labelled one.
    """
    spark = docs.sparkSession
    picked, heft = training_labels(labels, per_label)
    ids = spark.createDataFrame([(i,) for i in sorted(picked)], "doc_id long")
    text = F.col("text").cast("string")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.xxhash64(text).alias("at"), text.alias("text")).alias("t")).join(F.broadcast(ids), "doc_id", "left_semi")
    sample = sample.groupBy("doc_id").agg(F.min("t").alias("t")).select("doc_id", "t.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = TermBuckets()
        for b in batches:
            x = [terms(t, buckets) for t in b.column("text").to_pylist()]
            sparse = [(np.flatnonzero(v).astype(np.int16), v[v > 0].astype(np.float32)) for v in x]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([i.tobytes() for i, _ in sparse], pa.binary()), pa.array([v.tobytes() for _, v in sparse], pa.binary())], ["doc_id", "at", "weight"])

    rows = sorted(sample.mapInArrow(bounded(run, _CHUNK), "doc_id long, at binary, weight binary").collect(), key=lambda r: r.doc_id)
    x = np.zeros((len(rows), BUCKETS))
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.at, np.int16)] = np.frombuffer(r.weight, np.float32)
    counted = document_frequencies(docs)
    idf = np.log((1 + counted[-1]) / (1 + counted[:-1])) + 1
    space = Space.fit(x, np.array([picked[r.doc_id] for r in rows], float), idf, heft)
    del x, rows
    driver_trimmed(spark)
    return space


def score(docs: DataFrame, space: Space, threshold: float = THRESHOLD) -> DataFrame:
    """docs with quality_score (0 to 1) and accepted; where docs has such a column, the new one's name gets an underscore.

    A null or empty text has no terms and gets the share of label 1 among the labelled
    rows; without labelled documents every score is 0.5. Repeated rows score alike, a
    null doc_id is scored like any other, and a text is held whole, whatever its length,
    one slice of rows at a time. An empty table stays empty.
    """
    names, sent = docs.columns, docs.sparkSession.sparkContext.broadcast(space)
    new = [fresh(names, "quality_score"), fresh(names, "accepted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = TermBuckets()
        for b in batches:
            x = np.array([terms(t, buckets) for t in b.column(names.index("text")).to_pylist()])
            s = sent.value.score(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array(s >= threshold, pa.bool_())], [*names, *new])

    return docs.mapInArrow(bounded(run, _CHUNK), T.StructType([*docs.schema.fields, T.StructField(new[0], T.DoubleType()), T.StructField(new[1], T.BooleanType())]))


def accepted(docs: DataFrame, space: Space, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold; columns and edge cases as in score."""
    return score(docs, space, threshold).filter(F.col(fresh(docs.columns, "accepted"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted; a null doc_id has a null held_out."""
    space = fit(docs, labels)
    rows = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), space)
    return rows.select(
        "doc_id", (fold_of(F.col("doc_id")) == 2).alias("held_out"), F.col("quality_score").alias("score"), F.col("accepted").cast("int").alias("predicted")
    )
