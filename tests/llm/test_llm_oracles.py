"""The corpus queries that SQL can express, against DuckDB; and that every query of the subpackage is registered."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallywell.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def cell(v):
    return "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, DIR).select(*columns).collect()
    assert sorted(tuple(map(cell, r)) for r in got) == sorted(tuple(map(cell, r)) for r in want.fetchall())


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
