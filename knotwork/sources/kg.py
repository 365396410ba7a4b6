"""Knowledge graphs from tab-separated files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "valid", "test")


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split("value", "\t", -1).alias("f"))


def read_triples(spark: SparkSession, folder: str) -> DataFrame:
    """h, r, t, split from folder/train.txt, valid.txt, test.txt; lines without exactly three fields and missing files are left out."""
    jvm = spark.sparkContext._jvm
    out = None
    for split in SPLITS:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{split}.txt")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            continue
        f = _fields(spark, path.toString()).filter(F.size("f") == 3)
        part = f.select(F.col("f")[0].alias("h"), F.col("f")[1].alias("r"), F.col("f")[2].alias("t"), F.lit(split).alias("split"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "h string, r string, t string, split string")


def read_bipartite(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """edges (a, b) and entity (id, name, side) from lines id, name, id, name under a header."""
    rows = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    a_id, a_name, b_id, b_name = rows.columns[:4]
    rows = rows.filter(F.col(b_name).isNotNull())
    edges = rows.select(F.col(a_id).alias("a"), F.col(b_id).alias("b"))
    side = lambda i, n, s: rows.groupBy(F.col(i).alias("id")).agg(F.max(n).alias("name")).withColumn("side", F.lit(s))
    return edges, side(a_id, a_name, "a").unionByName(side(b_id, b_name, "b"))
