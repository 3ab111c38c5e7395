"""Every registered query against its SQL twin in DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registered

FOLDER = "/root/testdata/sf0.001"
TABLES = sorted(p.stem for p in Path(FOLDER).glob("*.parquet"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(value)
    if isinstance(value, bool) or value is None:
        return str(value)
    return repr(float(value)) if isinstance(value, int) else str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([plain(row[i]) for i in order] for row in rows)


#: The queries of the llm subpackage have tests of their own.
OWN = sorted(name for name in registered.queries() if not name.startswith("op") and name != "pipeline")


@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, duck, name):
    df = registered.queries()[name](spark, FOLDER)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    result = duck.execute(registered.oracle_sql()[name])
    want = canonical([d[0] for d in result.description], result.fetchall())
    assert got == want


def test_every_query_has_a_twin():
    assert set(OWN) <= registered.oracle_sql().keys() <= registered.queries().keys()


def test_entry(spark):
    assert registered.entry(spark).count() == 1
