"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tallyfield.plans.catalog import ORACLE_SQL, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        path = f"{DIR}/{f}"
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def cell(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.10g}" if not math.isnan(float(v)) else "nan"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    rows = sorted(tuple(cell(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    assert rows == sorted(tuple(cell(v) for v in r) for r in want.fetchall())
    assert rows


def test_queries_without_sql_give_rows(spark):
    for name in QUERIES.keys() - ORACLE_SQL.keys():
        assert QUERIES[name](spark, DIR).count() > 0
