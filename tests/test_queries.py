"""Every named query that SQL can express, against DuckDB on the same tables."""

import os

import duckdb
import numpy as np
import pytest

from prosegauge.plans.oracle_more import all_sql
from prosegauge.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
SQL = all_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canonical(df):
    columns = sorted(df.columns)
    plain = df[columns].astype(object).where(df[columns].notna(), None)
    return plain.map(lambda v: v if v is None else round(float(v), 9) if isinstance(v, float | np.floating) else v).astype(str).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    ours, theirs = canonical(QUERIES[name](spark, SF).toPandas()), canonical(duck.execute(SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns) and ours.equals(theirs), name


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
