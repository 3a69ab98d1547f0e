"""Every registered query against its SQL, and the shape of every plan."""
import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of
from conftest import DATA, plan_of
from tallyloom.catalog import QUERIES

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    plan = plan_of(df)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert operator not in plan
    if name in SQL:
        found = db.sql(SQL[name])
        assert sorted(found.columns) == columns
        theirs = found.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
        assert rows_of(mine, columns) == rows_of(theirs, columns)
    else:
        assert mine


def test_entry(spark):
    results = {r["result"] for r in entry.entry(spark).select("result").distinct().collect()}
    assert results == {"trend", "breakdown", "share", "histogram", "scatter"}
