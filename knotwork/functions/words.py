"""Tables that turn numbers into words, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds, checked from high to low, and their phrases.
HOMOPHILY = [
    (0.60, "strongly homophilous"),
    (0.30, "moderately homophilous"),
    (0.10, "weakly homophilous"),
    (-0.10, "mixed (no homophily)"),
    (-1.01, "heterophilous (ties tend to cross groups)"),
]
HOMOPHILY_BELOW = "heterophilous (ties tend to cross groups)"
HOMOPHILY_UNDEFINED = "undefined (only one group present)"
CORRESPONDENCE = [
    (0.90, "almost exactly"),
    (0.75, "closely"),
    (0.60, "loosely"),
    (0.00, "only weakly"),
]
CORRESPONDENCE_BELOW = "not at all"
#: Ratio of mean betweenness from which a group counts as more central.
CENTRALITY_RATIO = 1.5


def word_column(value: Column, table: list[tuple[float, str]], below: str) -> Column:
    out = F.lit(below)
    for least, phrase in reversed(table):
        out = F.when(value >= least, F.lit(phrase)).otherwise(out)
    return out


def homophily_column(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit(HOMOPHILY_UNDEFINED)).otherwise(word_column(value, HOMOPHILY, HOMOPHILY_BELOW))


def correspondence_column(value: Column) -> Column:
    return word_column(value, CORRESPONDENCE, CORRESPONDENCE_BELOW)
