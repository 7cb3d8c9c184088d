"""Every query of the engine against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from millrace.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)


def rows(columns, found):
    return sorted((tuple(map(value, r)) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = df.select(*(f"`{c}`" for c in columns)).collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert found
        return
    expected = duck.sql(sql)
    assert columns == sorted(expected.columns)
    assert rows(columns, found) == rows(columns, expected.select(*(f'"{c}"' for c in columns)).fetchall())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.queries()["filter_cmp"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan and "l_shipdate" not in plan
