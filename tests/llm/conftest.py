import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Make a documents table from (doc_id, text) or (doc_id, text, source)."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def clashing():
    """Add columns whose names the operators use inside."""

    def add(df):
        for c in ("size", "kept", "component_id", "score", "key", "rid", "at", "crc", "bytes", "m", "p", "slot", "shard", "h1", "h2", "line", "line_no", "first", "sig", "n", "row", "__n"):
            df = df.withColumn(c, F.lit("x"))
        return df

    return add
