"""Baselines on feature tables: (…, id, features array<double>, label)."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scaling(train: DataFrame, center: bool = True) -> tuple[list[float], list[float]]:
    """Means (0 without centring) and population deviations (1 where there is none) of the features, in one pass."""
    width = train.select(F.size("features")).first()[0]
    moments = train.agg(*[f(F.element_at("features", i + 1)) for i in range(width) for f in (F.avg, F.stddev_pop)]).first()
    means, stds = moments[0::2], [s if s and s > 0 else 1.0 for s in moments[1::2]]
    return (list(means) if center else [0.0] * width), stds


def scaled(rows: DataFrame, means: list[float], stds: list[float]) -> DataFrame:
    mean, std = F.array(*[F.lit(float(m)) for m in means]), F.array(*[F.lit(float(s)) for s in stds])
    return rows.withColumn("features", F.zip_with(F.zip_with("features", mean, lambda x, m: x - m), std, lambda x, s: x / s))


def logistic(train: DataFrame, test: DataFrame, center: bool = True, c: float = 1.0, rounds: int = 5000) -> DataFrame:
    """test with prediction and probability (of the last class): standardised multinomial regression, L2 of weight 1 / (c n)."""
    means, stds = scaling(train, center)
    classes = sorted(r.label for r in train.select("label").distinct().collect())
    names = F.array(*[F.lit(x) for x in classes])
    prep = lambda d: scaled(d, means, stds).withColumns({"__x": array_to_vector("features"), "__y": (F.array_position(names, F.col("label")) - 1).cast("double")})
    if len(classes) < 2:
        return test.withColumns({"prediction": F.lit(classes[0]) if classes else F.lit(None), "probability": F.lit(1.0)})
    model = LogisticRegression(featuresCol="__x", labelCol="__y", family="multinomial", standardization=False, regParam=1.0 / (c * train.count()), maxIter=rounds, tol=1e-9).fit(prep(train))
    out = model.transform(prep(test).drop("__y"))
    return out.withColumns({"probability": F.element_at(vector_to_array("probability"), -1), "prediction": F.element_at(names, (F.col("prediction") + 1).cast("int"))}).select(*test.columns, "prediction", "probability")


def majority(train: DataFrame) -> DataFrame:
    """label: the commonest, the first of equal ones."""
    return train.groupBy("label").agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "label").limit(1).select("label")


def ridge(train: DataFrame, test: DataFrame, alpha: float = 1.0) -> DataFrame:
    """test with prediction of value: standardised ridge by the normal equations, summed up in one aggregate pass.

    A single training row predicts its value.
    """
    means, stds = scaling(train)
    d = len(means)
    rows = scaled(train, means, stds).select(F.col("value").cast("double").alias("y"), F.col("features").alias("x"))
    x = [F.col("x")[i] for i in range(d)]
    sums = rows.agg(F.count(F.lit(1)), F.avg("y"), *[F.sum(x[i] * F.col("y")) for i in range(d)], *[F.sum(x[i] * x[j]) for i in range(d) for j in range(i, d)]).first()
    n, mean, xy, flat = sums[0], sums[1], np.array(sums[2 : 2 + d], float), sums[2 + d :]
    weights = np.zeros(d)
    if n >= 2:
        gram = np.zeros((d, d))
        gram[np.triu_indices(d)] = flat
        gram = np.triu(gram) + np.triu(gram, 1).T
        weights = np.linalg.solve(gram + alpha * np.eye(d), xy)
    w = F.array(*[F.lit(float(v)) for v in weights])
    value = F.aggregate(F.zip_with("features", w, lambda a, b: a * b), F.lit(float(mean)), lambda s, v: s + v)
    return scaled(test, means, stds).withColumn("prediction", value).drop("features").join(test.select("id", "features"), "id")


def mean_value(train: DataFrame, test: DataFrame) -> DataFrame:
    return test.join(F.broadcast(train.agg(F.avg("value").alias("prediction"))))


def degree_one_hot(degrees: DataFrame, most: int = 50) -> DataFrame:
    """degrees with features: a one at min(deg, most)."""
    at = F.least("deg", F.lit(most))
    return degrees.withColumn("features", F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: (i == at).cast("double")))


def principal(rows: DataFrame, k: int = 128) -> DataFrame:
    """rows with features projected on the k first principal components and set to unit length."""
    from pyspark.ml.feature import PCA, Normalizer

    x = rows.withColumn("__x", array_to_vector("features"))
    width = rows.select(F.size("features")).first()[0]
    pca = PCA(k=min(k, width), inputCol="__x", outputCol="__p").fit(x)
    out = Normalizer(p=2.0, inputCol="__p", outputCol="__n").transform(pca.transform(x))
    return out.withColumn("features", vector_to_array("__n")).drop("__x", "__p", "__n")
