"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target in words; a document of a source is taken
target / source size times in expectation: the whole part for sure, the fractional
part p by a draw. The draws depend on each other: two documents of one source with
open fractions trade words, so that p_i * size_i + p_j * size_j stays as it is, until
one fraction is 0 or 1. Which way the words go is random with the odds that keep
every expectation. A task folds the documents of one (source, bucket) this way into
at most one open fraction; the open ones of 64 buckets fold again, level by level,
until a source has one left, which a last draw settles. So the words that a source
gives differ from its target by less than one document, as a rule a small one:
documents with a large share of a bucket's words trade first, with all others at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.common import durable

#: No source is taken more often than this.
MOST_REPEATS = 3
#: Documents of a source that one task folds, about.
BUCKET_ROWS = 1_000
#: Open fractions that one group of a later level folds.
FAN_IN = 64
#: A document with more than this share of a bucket's words is settled against the rest of the bucket at once.
LARGE = 0.005
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(rows: DataFrame, most_repeats: int = MOST_REPEATS, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, n_docs, target from rows (source, size, m); m rows of that size.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ... Targets share the sum
    of all sizes by weight; one that passes most_repeats times its source's size stops
    there and the rest is shared anew. In the order of cap / weight the sources that
    stop are a prefix; the share per unit of weight that holds is the largest one that
    the next source in that order still takes. The ranking holds one row a source.
    """
    by = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    by = by.withColumns({"w": weight.cast("long"), "cap": F.col("source_size") * most_repeats})
    soon = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    prior = soon.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(prior), F.lit(0))
    heft = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(prior), F.lit(0))
    by = by.withColumn("share", left / heft)
    by = by.withColumn("share", F.max(F.when(F.col("share") * F.col("w") <= F.col("cap"), F.col("share"))).over(everything))
    target = F.least(F.col("share") * F.col("w"), F.col("cap").cast("double"))
    return by.select("source", "source_size", "n_docs", target.alias("target"))


def settle_large(p: np.ndarray, size: np.ndarray, draws: np.random.Generator, share: float = LARGE) -> np.ndarray:
    """Settle each open document of more than `share` of all words against the ones after it together.

    The document goes to 1 with odds p, and the others give it c_j * (1 - p) words each,
    or else to 0, and each of them takes c_j * p; sum(c) is its size, so every
    expectation and sum(p * size) stay. Where the others have too little room it stays
    open. A large document would otherwise be the one that is open at the end.
    """
    p = np.array(p, float)
    for i in np.flatnonzero(size > share * size.sum()):
        x = p[i]
        if not 0.0 < x < 1.0 or i + 1 == len(p):
            continue
        rest = slice(i + 1, None)
        with np.errstate(over="ignore"):  # a fraction next to 0 or 1 sets no bound on that side
            room = np.minimum(p[rest] * size[rest] / (1.0 - x), (1.0 - p[rest]) * size[rest] / x)
        room[(p[rest] <= 0.0) | (p[rest] >= 1.0)] = 0.0
        if room.sum() < size[i]:
            continue
        c = np.divide(room * (size[i] / room.sum()), size[rest], out=np.zeros_like(room), where=room > 0)
        up = draws.random() < x
        p[i] = 1.0 if up else 0.0
        p[rest] = np.clip(p[rest] - c * (1.0 - x) if up else p[rest] + c * x, 0.0, 1.0)
    return p


def fold(p: list[float], size: list[float], draws: np.random.Generator) -> list[float]:
    """Trade words between open fractions until at most one is left; sum(p * size) stays."""
    p, u, cur = list(p), draws.random(len(p)).tolist(), -1
    for j, x in enumerate(u):
        if not 0.0 < p[j] < 1.0:
            continue
        if cur < 0:
            cur = j
            continue
        a, b = size[cur], size[j]
        up = min((1.0 - p[cur]) * a, p[j] * b)  # words that cur can take from j
        down = min(p[cur] * a, (1.0 - p[j]) * b)  # and j from cur
        if x * (up + down) < down:
            full = (1.0 - p[cur]) * a <= p[j] * b
            p[cur], p[j] = (1.0, max(0.0, p[j] - up / b)) if full else (min(1.0, p[cur] + up / a), 0.0)
        else:
            empty = p[cur] * a <= (1.0 - p[j]) * b
            p[cur], p[j] = (0.0, min(1.0, p[j] + down / b)) if empty else (max(0.0, p[cur] - down / a), 1.0)
        cur = cur if 0.0 < p[cur] < 1.0 else j if 0.0 < p[j] < 1.0 else -1
    return p


def _fold_group(seed: int, level: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # The largest first: the open fraction that stays then tends to be of a small document.
        pdf = pdf.sort_values(["heft", "at", "at2", "bytes"], ascending=[False, True, True, True], kind="stable")
        draws = np.random.default_rng([seed, level, *(int(pdf["skey"].iloc[0]) & (2**64 - 1)).to_bytes(8, "big"), int(key[1])])
        heft = pdf["heft"].to_numpy(float)
        p = settle_large(pdf["p"].to_numpy(float), heft, draws) if level == 0 else pdf["p"]
        pdf["p"] = fold(p.tolist(), heft.tolist(), draws)
        return pdf

    return run


_ITEM = "source string, skey long, doc_id long, at long, at2 long, bytes int, size long, m long, heft long, source_size long, target double, whole long, p double, bucket long"


def item_key(docs: DataFrame) -> DataFrame:
    """docs with (at, at2, bytes), the key of a document: 128 bits of its source, doc_id and text, and the text's size.

    Documents without doc_id are told apart by their texts, so that they do not share a bucket.
    """
    known = [x for c in ("source", "doc_id", "text") for x in (F.col(c), F.col(c).isNull())]
    return docs.withColumns({"at": F.xxhash64(*known), "at2": F.xxhash64(F.lit(1), *known), "bytes": F.octet_length(F.coalesce(F.col("text"), F.lit("")))})


def mix_copies(docs: DataFrame, seed: int = 7, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """One row per document: its key (at, at2, bytes), source, doc_id, size, m, copies and its source's figures.

    Rows that agree in source, doc_id and text are one document of m rows, which share
    one decision and weigh m times their size. A text without words (or null) has size
    0, moves no target and is taken once; a text of any length is one document of that
    many words. A null source is a source, the last one, and a null doc_id one like any
    other. Documents of equal size trade in the order of their keys. An empty table
    gives an empty result; columns besides doc_id, source and text are ignored.
    """
    rows = item_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text"))
    rows = rows.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    items = rows.groupBy("source", "doc_id", "at", "at2", "bytes", "size").agg(F.count(F.lit(1)).alias("m"))
    items = durable(items)
    targets = source_targets(items, most_repeats).withColumnRenamed("source", "__source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    items = items.join(targets, F.col("source").eqNullSafe(F.col("__source"))).withColumns({
        "skey": F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()),
        "heft": F.col("size") * F.col("m"),
        "whole": F.when(F.col("size") > 0, F.floor(ratio)).otherwise(F.lit(1)).cast("long"),
        "p": F.when(F.col("size") > 0, ratio - F.floor(ratio)).otherwise(F.lit(0.0)),
        "bucket": F.pmod("at", F.ceil(F.col("n_docs") / BUCKET_ROWS)).cast("long"),
    })
    columns = [c.split()[0] for c in _ITEM.split(", ")]
    items = items.select(*columns)
    settled, level = [], 0
    while True:
        folded = durable(items.groupBy("skey", "bucket").applyInPandas(_fold_group(seed, level), _ITEM))
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        settled.append(folded.filter(~is_open))
        items = folded.filter(is_open)
        groups, sources = items.agg(F.count(F.lit(1)), F.countDistinct("skey")).first()
        if groups == sources:
            break
        level += 1
        items = items.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "skey", "at", "at2"), F.lit(1 << 30)) + 0.5) / F.lit(float(1 << 30))
    out = items.withColumn("p", F.when(u < F.col("p"), 1.0).otherwise(0.0))
    for part in settled:
        out = out.unionByName(part)
    return out.withColumn("copies", F.col("whole") + F.col("p").cast("long")).drop("p", "whole", "bucket", "heft", "skey")


def mix_report(docs: DataFrame, seed: int = 7) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken."""
    out = mix_copies(docs, seed).withColumn("__row", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; columns as they were."""
    columns = docs.columns
    copies = mix_copies(docs, seed).filter(F.col("copies") > 0).select("at", "at2", "bytes", "copies")
    keyed = item_key(docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")).drop("doc_id", "source", "text")
    out = keyed.join(copies, ["at", "at2", "bytes"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("row.*")
