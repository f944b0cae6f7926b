"""Every query with SQL against DuckDB, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        p = f"{DIR}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v + 0.0:.8g}" if isinstance(v, float) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"])
def test_oracle(spark, duck, name):
    got = entry.queries()[name](spark, DIR)
    want = duck.execute(entry.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"])
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["t", "event_type", "value"]
