"""Prompts as ordered text, and the truth beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The lines that frame a prompt.
EXAMPLES = "=== LABELED EXAMPLES ==="
QUERIES = "=== QUERIES (classify each) ==="
QUERIES_VALUES = "=== QUERIES (predict each) ==="
QUESTION = (
    "You are analyzing a graph. Here is a factual, deterministically-computed description of its structure (you do NOT have the raw graph, only this verbalized summary):\n\n"
    "{text}\n\nQuestion: {question}\n\nAnswer concisely, citing the specific numbers above that justify your reasoning."
)


def class_token(label: Column) -> Column:
    return F.concat(F.lit("CLASS"), label.cast("string"))


def prompts(header: Column, items: DataFrame, tokens: bool = True, queries_line: str = QUERIES) -> DataFrame:
    """run, prompt: the header, labelled blocks and query blocks in their order.

    items: run, role ("shot", "query"), ord, token (of shots), body. header is a column
    over run. A shot is "[token]\\nbody\\n", a query "Query ord:\\nbody\\n".
    """
    shot = F.concat(F.lit("["), F.col("token"), F.lit("]\n"), F.col("body"), F.lit("\n"))
    query = F.concat(F.lit("Query "), F.col("ord").cast("string"), F.lit(":\n"), F.col("body"), F.lit("\n"))
    is_shot = F.col("role") == "shot"
    blocks = items.select("run", F.when(is_shot, 0).otherwise(1).alias("part"), "ord", F.when(is_shot, shot).otherwise(query).alias("block"))
    rows = F.array_sort(F.collect_list(F.struct("part", "ord", "block")))
    lists = blocks.groupBy("run").agg(rows.alias("rows"))
    text = lambda part: F.transform(F.filter("rows", lambda x: x["part"] == part), lambda x: x["block"])
    lines = F.concat(F.array(header, F.lit(""), F.lit(EXAMPLES)), text(0), F.array(F.lit(queries_line)), text(1))
    return lists.select("run", F.array_join(lines, "\n").alias("prompt"))


def truth(items: DataFrame) -> DataFrame:
    """run, qid, label of the queries."""
    return items.filter(F.col("role") == "query").select("run", F.col("ord").alias("qid"), F.col("token").alias("label"))


def manifest(items: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """run, truth [[qid, label], …] and the columns of meta (run, …): one line of the manifest a run."""
    t = truth(items).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("qid", "label"))).alias("truth"))
    return t.join(meta, "run", "left") if meta is not None else t


def target_scale(items: DataFrame) -> DataFrame:
    """run, zmean, zstd of the shots' values; a deviation up to 1e-3 gives way to that of all values plus 1e-8."""
    shot = items.filter(F.col("role") == "shot").groupBy("run").agg(F.avg("value").alias("zmean"), F.stddev_pop("value").alias("s"))
    whole = items.groupBy("run").agg((F.stddev_pop("value") + 1e-8).alias("all"))
    return shot.join(whole, "run").select("run", "zmean", F.when(F.col("s") > 1e-3, F.col("s")).otherwise(F.col("all")).alias("zstd"))


def question(facts_text: DataFrame, asked: str) -> DataFrame:
    """graph_id, prompt: a question about one verbalised graph."""
    before, after = QUESTION.split("{text}")
    return facts_text.select("graph_id", F.concat(F.lit(before), F.col("text"), F.lit(after.format(question=asked))).alias("prompt"))


def pending(runs: DataFrame, answered: DataFrame) -> DataFrame:
    """The runs without a non-empty answer: where to go on after a stop."""
    done = answered.filter(F.trim("line") != "").select("run").distinct()
    return runs.join(done, "run", "left_anti")
