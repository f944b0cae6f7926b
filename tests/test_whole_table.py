"""The frequency query over doubles counts the whole table."""

import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_all_rows_are_counted(spark):
    got = entry.queries()["freq_double_bits"](spark, DIR)
    assert got.agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{DIR}/lineitem.parquet").count()
