"""A user whose values of a window are all 0 has the ratio NaN, as in SQL; it stopped the query before."""

import datetime
import math

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


def test_ratio_of_zeros(spark, tmp_path):
    at = lambda day, second: datetime.datetime(2024, 1, day, 0, 0, second)
    rows = [(1, at(1, 1), 7, "error", 0.0), (2, at(2, 2), 8, "error", 3.0), (3, at(2, 3), 8, "view", 1.0), (4, at(4, 3), 9, "view", 2.0), (5, at(4, 4), 9, "error", 0.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = entry.queries()["binop_ratio"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    order = lambda data: sorted((t, u, "nan" if math.isnan(v) else repr(v)) for t, u, v in data)
    assert order(map(tuple, got.select("t", "user_id", "value").collect())) == order(con.execute(entry.oracle_sql()["binop_ratio"]).fetchall())
    assert {(r.user_id, "nan" if math.isnan(r.value) else r.value) for r in got.collect()} == {(7, "nan"), (8, 0.75), (9, 0.0)}
