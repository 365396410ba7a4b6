"""Scores of predictions as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.plans.structure import nan


def _hits(truth: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    joined = truth.select(*keys, "qid", F.upper(F.col("label").cast("string")).alias("label")).join(answers.select(*keys, "qid", "token"), [*keys, "qid"], "left")
    return joined.withColumn("hit", F.coalesce((F.col("token") == F.col("label")).cast("double"), F.lit(0.0)))


def balanced_accuracy(truth: DataFrame, answers: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """keys, balanced_accuracy: the mean over classes of recall; no answer is wrong."""
    per = _hits(truth, answers, list(keys)).groupBy(*keys, "label").agg(F.avg("hit").alias("recall"))
    return per.groupBy(*keys).agg(F.avg("recall").alias("balanced_accuracy"))


def raw_accuracy(truth: DataFrame, answers: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """keys, accuracy; null where no answer was parsed."""
    some = answers.groupBy(*keys).agg(F.lit(True).alias("some"))
    per = _hits(truth, answers, list(keys)).groupBy(*keys).agg(F.avg("hit").alias("a"))
    return per.join(some, list(keys), "left").select(*keys, F.when(F.col("some"), F.col("a")).alias("accuracy"))


def regression_scores(truth: DataFrame, answers: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """keys, n, mae, rmse, r2 over answered queries, at least two. truth: qid, value, and zmean and zstd if answers are z-scores."""
    pred = F.col("pred") * F.col("zstd") + F.col("zmean") if "zstd" in truth.columns else F.col("pred")
    rows = truth.join(answers.select(*keys, "qid", F.col("value").alias("pred")), [*keys, "qid"]).withColumn("err", pred - F.col("value"))
    spread = F.var_pop("value") * F.count(F.lit(1))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("err")).alias("mae"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"), F.sum(F.col("err") * F.col("err")).alias("sse"), spread.alias("sst"))
    return out.filter(F.col("n") >= 2).select(*keys, "n", "mae", "rmse", F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).otherwise(nan()).alias("r2"))


def ranking_scores(ranked: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n, hits1, hits10, mrr from one row a query with rank (null: not ranked)."""
    r = F.col("rank")
    agg = [F.count(F.lit(1)).alias("n"), F.avg(F.coalesce((r <= 1).cast("double"), F.lit(0.0))).alias("hits1"), F.avg(F.coalesce((r <= 10).cast("double"), F.lit(0.0))).alias("hits10"), F.avg(F.coalesce(1 / r, F.lit(0.0))).alias("mrr")]
    return ranked.groupBy(*keys).agg(*agg)


def filtered_ranks(scored: DataFrame, truth: DataFrame, known: DataFrame) -> DataFrame:
    """qid, rank of the true entity after other true ones are taken out.

    scored: qid, ent and rank keys as place (smaller is better); truth: qid, ent; known:
    qid, ent of all true entities.
    """
    others = known.join(truth, ["qid", "ent"], "left_anti")
    left = scored.join(others, ["qid", "ent"], "left_anti")
    of = truth.join(left.select("qid", "ent", F.col("place").alias("mine")), ["qid", "ent"], "left")
    better = left.join(of.select("qid", "mine"), "qid").filter(F.col("place") < F.col("mine")).groupBy("qid").agg(F.count(F.lit(1)).alias("b"))
    return of.join(better, "qid", "left").select("qid", F.when(F.col("mine").isNotNull(), F.coalesce("b", F.lit(0)) + 1).alias("rank"))


def roc_auc(scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, auc of score for label (1 or 0), ties counting half: from the histogram of scores, null with one class only."""
    hist = scores.groupBy(*keys, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    w = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("p") * (F.coalesce(F.sum("n").over(w), F.lit(0)) + F.col("n") / 2)
    agg = hist.withColumn("won", won).groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return agg.select(*keys, F.try_divide(F.col("won"), F.col("p") * F.col("n")).alias("auc"))


def with_regret(scores: DataFrame, method: str = "method", baselines: tuple[str, ...] = ("classical", "majority")) -> DataFrame:
    """scores with regret: the best baseline less the method; positive is behind."""
    return scores.withColumn("regret", F.greatest(*baselines) - F.col(method))


def regret_summary(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n, mean, median, worst, n_at_least (<= 0), n_within (<= .05), n_worse (> .10) of regret."""
    r = F.col("regret")
    rows = rows.filter(r.isNotNull())
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean"), F.percentile(r, 0.5).alias("median"), F.max(r).alias("worst"),
        F.count_if(r <= 0).alias("n_at_least"), F.count_if(r <= 0.05).alias("n_within"), F.count_if(r > 0.10).alias("n_worse"),
    )


def over_seeds(scores: DataFrame, keys: tuple[str, ...], value: str = "score") -> DataFrame:
    """keys, n, mean, std (population) over seeds."""
    return scores.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


#: The buckets of what names alone give away.
MEMORISED = [(0.85, "high"), (0.65, "moderate")]


def fusion_gap(scores: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """keys, knowledge, anon, fusion, gap (fusion less the better single arm), wins, memorisation from (keys, condition, score)."""
    wide = scores.groupBy(*keys).pivot("condition", ["knowledge", "anon", "fusion"]).agg(F.avg("score"))
    out = wide.withColumn("gap", F.col("fusion") - F.greatest("knowledge", "anon"))
    level = F.when(F.col("knowledge").isNull(), F.lit(None).cast("string"))
    for least, name in MEMORISED:
        level = level.when(F.col("knowledge") >= least, F.lit(name))
    return out.withColumns({"wins": F.col("gap") > 0, "memorisation": level.otherwise(F.lit("low"))})


def ladder(scores: DataFrame, reference: float | Column) -> DataFrame:
    """model, score, beats the reference, best first (place from 1)."""
    ref = reference if isinstance(reference, Column) else F.lit(reference)
    place = F.row_number().over(Window.orderBy(F.col("score").desc(), "model"))
    return scores.select("model", "score", (F.col("score") > ref).alias("beats"), place.alias("place"))


def sweep_table(scores: DataFrame, methods: list[str], domains: list[str]) -> DataFrame:
    """dataset, domain, one column a method, at: datasets by the order of domains and then name."""
    wide = scores.groupBy("dataset", "domain").pivot("method", methods).agg(F.avg("score"))
    rank = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain"))
    rank = F.when(rank > 0, rank).otherwise(F.lit(len(domains) + 1))
    return wide.withColumn("at", F.row_number().over(Window.orderBy(rank, F.lower("dataset"))) - 1)
