"""Records of runs: a checked row format, stored by run and kind, with an index that says which attempt of a run counts.

A run is written to a folder of its own attempt first; then its index entry is
replaced, in one small write. Readers go by the index, so a run that was lost
half-way is never seen, and a run again takes the place of the one before as a whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Unsupported

# fixed values of the record format
VERSION = 1
KINDS = ("query_result", "low_level", "app_state", "fidelity_event", "fidelity_summary")

#: A value is a number or a string, never both.
SCHEMA = "schema_version int, time long, kind string, run_id string, labels map<string,string>, metric string, value_num double, value_str string, unit string"
_NAMES = [x.split()[0] for x in SCHEMA.replace("map<string,string>", "map").split(", ")]
_INDEX = "run_id string, use_case string, start long, end long, rows long, attempt string, details string"


def record(time: Column, kind: str, run_id: str, labels: dict[str, Column], metric: Column | str, value: Column, unit: str, text: bool = False) -> list[Column]:
    """The columns of a record. text: the value is a string."""
    if kind not in KINDS:
        raise Unsupported(f"record kind {kind}", "not one of " + ", ".join(KINDS))
    pairs = [x for k, v in labels.items() for x in (F.lit(k), v.cast("string"))]
    none = lambda t: F.lit(None).cast(t)
    return [
        F.lit(VERSION).alias("schema_version"), time.cast("long").alias("time"), F.lit(kind).alias("kind"), F.lit(run_id).alias("run_id"), F.create_map(*pairs).cast("map<string,string>").alias("labels"),
        (F.lit(metric) if isinstance(metric, str) else metric).alias("metric"), (none("double") if text else value.cast("double")).alias("value_num"), (value.cast("string") if text else none("string")).alias("value_str"), F.lit(unit).alias("unit"),
    ]


def checked(rows: DataFrame, run_id: str) -> DataFrame:
    """rows, of which each that isn't a record of this run is an error that says why, at the task that meets it."""
    if set(rows.columns) != set(_NAMES):
        raise Unsupported(f"record fields {sorted(rows.columns)}", f"not {sorted(_NAMES)}")
    empty = lambda c: F.coalesce(F.length(c) == 0, F.lit(True))
    why = (
        F.when(~F.col("schema_version").eqNullSafe(F.lit(VERSION)), F.concat(F.lit("schema_version is not "), F.lit(str(VERSION))))
        .when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "its kind is none of the format's")
        .when(~F.col("run_id").eqNullSafe(F.lit(run_id)), "it is of another run")
        .when(F.col("time").isNull(), "it has no time")
        .when(empty("metric") | empty("unit"), "its metric or unit is empty")
        .when(F.col("labels").isNull() | F.exists(F.map_values("labels"), lambda v: v.isNull()), "a label has no value")
        .when(F.col("value_num").isNull() == F.col("value_str").isNull(), "its value is not a number or else a string")
    )
    ok = F.when(why.isNull(), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("record refused: "), why)))
    return rows.select(_NAMES).withColumn("kind", ok)


def write_run(rows: DataFrame, root: str, run_id: str, use_case: str, details: str = "{}") -> str:
    """Stores a run's records and makes them the ones that count; gives the attempt's name. A run without rows is an error."""
    spark, attempt = rows.sparkSession, uuid.uuid4().hex
    path = f"{root}/rows/{attempt}"
    checked(rows, run_id).write.partitionBy("kind").parquet(path)
    there = spark.read.schema(SCHEMA).parquet(path)
    n, start, end = there.agg(F.count(F.lit(1)), F.min("time"), F.max("time")).first()
    if not n:
        raise Unsupported(f"run {run_id}", "it has no rows")
    entry = spark.createDataFrame([(run_id, use_case, start, end, n, attempt, details)], _INDEX)
    # one partition of one file: dynamic overwriting moves the whole partition at its commit
    entry.coalesce(1).withColumn("run", F.sha2("run_id", 256)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{root}/index")
    return attempt


def index(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, use_case, start, end, rows, attempt, details): one row for each run."""
    return spark.read.schema(f"{_INDEX}, run string").parquet(f"{root}/index").drop("run")


def read_runs(spark: SparkSession, root: str, run_ids: Sequence[str] | None = None, kinds: Sequence[str] | None = None) -> DataFrame:
    """The records of the runs that count; kinds are partitions, so others aren't opened."""
    runs = index(spark, root)
    runs = runs.filter(F.col("run_id").isin(*run_ids)) if run_ids is not None else runs
    attempts = [r.attempt for r in runs.select("attempt").collect()]  # one short name for each run
    if not attempts:
        return spark.createDataFrame([], SCHEMA)
    parts = None
    for a in attempts:
        one = spark.read.schema(SCHEMA).parquet(f"{root}/rows/{a}")
        parts = one if parts is None else parts.unionByName(one)
    parts = parts.filter(F.col("kind").isin(*kinds)) if kinds else parts
    return parts.select(_NAMES)


def write_groups(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """A folder of CSV files with a header for each group; groups that are large have several files."""
    rows.write.mode("overwrite").partitionBy(*by).option("header", True).csv(path)
