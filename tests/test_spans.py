"""Spans that are empty or lack an end stay rows of their own, as the SQL says."""

import duckdb

from lectern.operators import citations
from lectern.plans import registry
from tests.oracle import plain, sparked


def test_merge_spans_empty_and_null(spark, tmp_path):
    rows = [(1, 5, 3.0), (1, 6, 1.0), (1, 40, -1.0), (1, 40, -1.0), (1, 50, None), (1, 50, None), (1, None, 2.0), (1, None, 2.0), (None, 7, 1.0), (None, 7, 1.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    con.execute("SET threads=1")  # equal spans are in one order in both of its windows
    want = sorted([plain(x) for x in r] for r in con.execute(f'SELECT begin, "end", id FROM ({registry.ORACLES["merge_spans"]})').fetchall())
    got = sparked(registry.QUERIES["merge_spans"](spark, str(tmp_path)))[1]
    assert got == want and len(got) == 8


def test_equal_spans_are_one(spark):
    spans = spark.createDataFrame([(1, 8, 17), (1, 17, 27), (1, 17, 27), (1, 27, 30)], "id long, begin long, end long")
    assert sorted(tuple(r) for r in citations.merge_spans(spans).collect()) == [(1, 8, 17), (1, 17, 27), (1, 27, 30)]
