"""The SQL of operators against their queries, on rows that are out of the ordinary."""

from collections import Counter

import duckdb
import pytest

from knotwork.llm import near_dedup, shard_tree

TEXT = "one two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (1, TEXT), (2, TEXT.upper()), (3, TEXT + " thirteen"), (4, "Straße Ünïcode 王小明 " + TEXT), (5, None), (6, ""), (7, " \t\n"), (8, "a b"), (9, "A  b"), (9, "a b"),
    (-10, TEXT + " fourteen fifteen"), (None, TEXT), (None, None), (11, TEXT), (11, "other words of the same document here"), (2**40, "other words of the same document here"),
]


@pytest.mark.parametrize("operator, sql", [(near_dedup.link_documents, near_dedup.ORACLE), (shard_tree.shard_documents, shard_tree.ORACLE)])
@pytest.mark.parametrize("rows", [ROWS, []])
def test_sql_gives_the_rows(spark, operator, sql, rows):
    found = operator(spark.createDataFrame(rows, "doc_id long, text string"))
    names = sorted(found.columns)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.sql(sql)
    assert sorted(want.columns) == names
    assert Counter(tuple(r[c] for c in names) for r in found.collect()) == Counter(con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
