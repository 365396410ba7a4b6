"""Knowledge graphs: vocabularies, frequency priors, and a bilinear-diagonal embedding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.durable import dealt, durable
from knotwork.operators.neighborhoods import token


def numbered(rows: DataFrame, *order: Column, name: str = "id", n: int = 0) -> DataFrame:
    """rows with their place from 0 in an order of all of them, in one long column.

    Numbered range by range, n of them where that is more than Spark would make: a task
    numbers its range from what the ranges before hold (one row each, which is what is broadcast).
    """
    ranges = (n,) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ()
    v = durable(rows.repartitionByRange(*ranges, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = v.groupBy("__p").count().select("__p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return dealt(v, n, "__p").withColumn("__n", inside).join(F.broadcast(starts), "__p").withColumn(name, F.col("__start") + F.col("__n")).drop("__p", "__n", "__start")


def vocabulary(values: DataFrame, name: str = "value", prefix: str = "E") -> DataFrame:
    """value, id (place in code-point order from 0), token padded to the width of the largest id."""
    ids = numbered(values.select(F.col(name).alias("value")).distinct(), F.col("value"))
    width = len(str(max(0, ids.count() - 1)))
    return ids.withColumn("token", token(F.col("id"), prefix, width))


def entities(triples: DataFrame) -> DataFrame:
    return vocabulary(triples.select(F.explode(F.array("h", "t")).alias("value")))


def relations(triples: DataFrame) -> DataFrame:
    v = vocabulary(triples.select(F.col("r").alias("value")))
    return v.withColumn("token", token(F.col("id"), "R", 2))


def encoded(triples: DataFrame, ents: DataFrame, rels: DataFrame) -> DataFrame:
    """triples with hid, rid, tid."""
    return (
        triples.join(ents.select(F.col("value").alias("h"), F.col("id").alias("hid")), "h")
        .join(rels.select(F.col("value").alias("r"), F.col("id").alias("rid")), "r")
        .join(ents.select(F.col("value").alias("t"), F.col("id").alias("tid")), "t")
    )


def commonest_relation(triples: DataFrame) -> DataFrame:
    """r: the relation of most triples, the first of equal ones."""
    return triples.groupBy("r").agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "r").limit(1).select("r")


def tail_order(triples: DataFrame, n: int = 0) -> tuple[DataFrame, DataFrame]:
    """The order in which a relation's tails are guessed: by tail count of the relation, tail count at all, entity.

    Two tables hold it without a row for every relation and entity: own (r, ent, place
    from 1) of the tails that a relation has, and every (ent, at from 0), the order of
    all entities, in which the others follow. What has a row an entity is dealt to n
    partitions, where that is more than Spark would make.
    """
    per = durable(triples.groupBy("r", F.col("t").alias("ent")).agg(F.count(F.lit(1)).alias("c")))
    overall = per.groupBy("ent").agg(F.when(F.col("ent").isNotNull(), F.sum("c")).otherwise(0).alias("all"))
    heads = dealt(triples.select(F.col("h").alias("ent"), F.lit(0).cast("long").alias("all")), n, "ent").distinct()
    ents = dealt(heads.unionByName(overall), n, "ent").groupBy("ent").agg(F.max("all").alias("all"))
    every = durable(numbered(ents, F.col("all").desc(), F.col("ent"), name="at", n=n).select("ent", "at"))
    per = dealt(per, n, "ent").join(dealt(every, n, "ent"), "ent")
    place = F.row_number().over(Window.partitionBy("r").orderBy(F.col("c").desc(), "at"))
    return durable(per.withColumn("place", place).select("r", "ent", "at", "place")), every


def _placed(asked: DataFrame, own: DataFrame, every: DataFrame, n: int = 0) -> DataFrame:
    """asked (r, ent) with place: that of a relation's own tail, or after these in the order of all entities."""
    asked = durable(asked.select("r", "ent").distinct())
    mine = asked.join(own.select("r", "ent", "place"), ["r", "ent"])
    sizes = own.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    others = asked.join(own, ["r", "ent"], "left_anti").join(every, "ent").select("r", "ent", "at", F.lit(0).alias("own"))
    # Own tails that come before another entity in the order of all are not counted twice.
    line = others.unionByName(own.select("r", "ent", "at", F.lit(1).alias("own")))
    before = F.sum("own").over(Window.partitionBy("r").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    line = line.withColumn("before", F.coalesce(before, F.lit(0))).filter("own = 0").join(sizes, "r", "left")
    late = line.select("r", "ent", (F.coalesce("n", F.lit(0)) + F.col("at") - F.col("before") + 1).alias("place"))
    return mine.unionByName(late)


def frequency_tail_ranks(triples: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, ent, place: all entities for each query (qid, r), a row for every query and entity.

    For vocabularies that are to be listed whole; frequency_top_tails and frequency_ranks need no such table.
    """
    own, every = tail_order(triples)
    asked = queries.select("r").distinct().withColumn("all", F.lit(1)).join(every.select("ent").withColumn("all", F.lit(1)), "all")
    return queries.select("qid", "r").join(_placed(asked, own, every), "r").select("qid", "ent", "place")


def frequency_top_tails(triples: DataFrame, queries: DataFrame, k: int = 10, n: int = 0) -> DataFrame:
    """qid, ent, place: the first k entities for each query (qid, r).

    A relation with fewer than k tails of its own takes the rest from the first k of
    the others, which are among the first 2 k of all.
    """
    own, every = tail_order(triples, n)
    few = own.groupBy("r").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < k).select("r")
    known = own.select("r").distinct()
    asked = queries.select("r").distinct()
    short = asked.join(few, "r", "left_semi").unionByName(asked.join(known, "r", "left_anti"))
    first = every.filter(F.col("at") < 2 * k).agg(F.collect_list("ent").alias("first"))  # 2 k names
    more = short.join(F.broadcast(first)).select("r", F.explode("first").alias("ent"))
    places = _placed(more.unionByName(own.filter(F.col("place") <= k).select("r", "ent")), own, every).filter(F.col("place") <= k)
    return queries.select("qid", "r").join(places, "r").select("qid", "ent", F.col("place").cast("int").alias("place"))


def frequency_ranks(triples: DataFrame, n: int = 0) -> DataFrame:
    """h, r, t, rank: the filtered rank of the tail of each test triple (h, r, t, split); null where training never saw it.

    True tails of the same head and relation, of any split, do not count where they come
    before the answer. They get a place each and are ordered once for all tests of their
    head, not once for each, and are dealt to n partitions where that is more than Spark
    would make.
    """
    own, every = tail_order(triples.filter("split = 'train'"), n)
    places = durable(_placed(triples.select("r", F.col("t").alias("ent")), own, every, n))
    line = dealt(triples.select("h", "r", F.col("t").alias("ent"), "split"), n, "r", "ent").join(dealt(places, n, "r", "ent"), ["r", "ent"], "left")
    # Equal triples have one place, so what comes before counts each tail once; places from training come before none.
    ahead = F.dense_rank().over(Window.partitionBy("h", "r").orderBy(F.col("place").asc_nulls_last())) - 1
    ahead = F.when(F.col("h").isNotNull(), ahead).otherwise(0)
    ranked = dealt(line, n, "h", "r").withColumn("rank", F.col("place") - ahead).filter("split = 'test'")
    return ranked.select("h", "r", F.col("ent").alias("t"), "rank")


def train_embedding(triples: np.ndarray, n_ent: int, n_rel: int, seed: int, dim: int = 32, epochs: int = 60, rate: float = 0.1, decay: float = 1e-4, negatives: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """E, W of score(h, r, t) = sum(E[h] * W[r] * E[t]), by stochastic gradients on logistic loss against drawn tails.

    Sequential by nature, so one task trains it, on vocabularies that fit one machine.
    A step takes a batch of triples at once.
    """
    rng = np.random.default_rng(seed)
    ent, rel = rng.normal(0, 0.1, (n_ent, dim)), rng.normal(0, 0.1, (n_rel, dim))
    for _ in range(epochs if len(triples) else 0):
        for part in np.array_split(rng.permutation(len(triples)), max(1, len(triples) // 64)):
            h, r, t = triples[part].T
            tails = np.concatenate([t[:, None], rng.integers(0, n_ent, (len(part), negatives))], 1)
            want = np.zeros(tails.shape)
            want[:, 0] = 1.0
            hr = ent[h] * rel[r]
            g = 1 / (1 + np.exp(-np.einsum("bd,bkd->bk", hr, ent[tails]))) - want
            pull = np.einsum("bk,bkd->bd", g, ent[tails])
            moves = ((h, pull * rel[r]), (tails.ravel(), (g[..., None] * hr[:, None]).reshape(-1, ent.shape[1])))
            turn = pull * ent[h] + decay * rel[r]
            for at, move in moves:
                np.add.at(ent, at, -rate * (move + decay * ent[at]))
            np.add.at(rel, r, -rate * turn)
    return ent, rel


def embedding_table(spark, ids: list[str], vectors: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors, strict=True)], "id string, vec array<double>")


def triple_scores(pairs: DataFrame, ents: DataFrame, rels: DataFrame) -> DataFrame:
    """pairs (…, h, r, t) with score, the triple product of their vectors."""
    vec = lambda d, k: d.select(F.col("id").alias(k), F.col("vec").alias(f"v{k}"))
    joined = pairs.join(vec(ents, "h"), "h").join(vec(rels, "r"), "r").join(vec(ents, "t"), "t")
    product = F.zip_with(F.zip_with("vh", "vr", lambda x, y: x * y), F.col("vt"), lambda x, y: x * y)
    return joined.withColumn("score", F.aggregate(product, F.lit(0.0), lambda s, x: s + x)).drop("vh", "vr", "vt")


def ranked_by_score(scored: DataFrame, candidate: str) -> DataFrame:
    """scored with place: candidates of a qid by score, the first of equal ones by name."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), candidate)))


def both_ways(triples: DataFrame) -> DataFrame:
    """triples and their inverses, relation r as r^-1."""
    return triples.select("h", "r", "t").unionByName(triples.select(F.col("t").alias("h"), F.concat("r", F.lit("^-1")).alias("r"), F.col("h").alias("t")))
