"""Columns that SQL can express, against DuckDB on the same tables."""

import duckdb
import pytest

from prosegauge.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    ours = [tuple(r[c] for c in columns) for r in QUERIES[name](spark, SF).collect()]
    assert sorted(ours, key=str) == sorted(found.fetchall(), key=str)
