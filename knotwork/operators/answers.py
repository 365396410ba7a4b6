"""Tolerant parsing of answer lines (run, model, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of answer lines.
CLASS_LINE = r"(?i)^\s*(?:query\s*)?(\d+)\s*[:.)\-]?\s+([A-Za-z0-9_]+)\s*$"
QUERY_ID = r"(?i)^\s*(?:query\s*)?(\d+)\b(.*)$"
NUMBER = r"[+\-]?\d+(?:\.\d+)?(?:[eE][+\-]?\d+)?"
RANKED_LINE = r"(?i)^\s*(?:query\s*)?(\d+)\s*[:.)\-]?\s+(.*\bE\d+.*)$"
ENTITY = r"(?i)(E\d+)"


def _last(rows: DataFrame, value: str) -> DataFrame:
    keys = [c for c in ("run", "model") if c in rows.columns]
    return rows.groupBy(*keys, "qid").agg(F.max_by(value, "line_no").alias(value))


def _id(pattern: str) -> Column:
    return F.try_to_number(F.regexp_extract(F.trim("line"), pattern, 1), F.lit("999999999")).cast("int")


def parse_classes(answers: DataFrame) -> DataFrame:
    """run, model, qid, token: "3: class1", "Query 3 CLASS1", ...; upper case, a later line wins."""
    rows = answers.filter(F.trim("line").rlike(CLASS_LINE)).withColumns({"qid": _id(CLASS_LINE), "token": F.upper(F.regexp_extract(F.trim("line"), CLASS_LINE, 2))})
    return _last(rows, "token")


def parse_numbers(answers: DataFrame) -> DataFrame:
    """run, model, qid, value: the last signed number after the id; a Unicode minus counts as one."""
    plain = answers.withColumn("line", F.translate(F.trim("line"), "−", "-"))
    rows = plain.filter(F.col("line").rlike(QUERY_ID)).withColumn("qid", _id(QUERY_ID))
    found = F.regexp_extract_all(F.regexp_extract("line", QUERY_ID, 2), F.lit(f"({NUMBER})"), F.lit(1))
    rows = rows.withColumn("value", F.try_element_at(found, F.lit(-1)).cast("double")).filter(F.col("value").isNotNull())
    return _last(rows, "value")


def parse_rankings(answers: DataFrame) -> DataFrame:
    """run, model, qid, ranked: entity tokens in order, upper case, each once."""
    rows = answers.filter(F.trim("line").rlike(RANKED_LINE)).withColumn("qid", _id(RANKED_LINE))
    found = F.regexp_extract_all(F.regexp_extract(F.trim("line"), RANKED_LINE, 2), F.lit(ENTITY), F.lit(1))
    return _last(rows.withColumn("ranked", F.array_distinct(F.transform(found, lambda x: F.upper(x)))), "ranked")
