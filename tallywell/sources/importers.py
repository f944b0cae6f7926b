"""Recorded traces as samples: (labels..., ts_ns or start_ns and end_ns, value)."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Unsupported

UNITS = {"s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "ns": 1}

#: The columns of the task usage files, which have no header.
TASK_USAGE = (
    "start_time", "end_time", "job_id", "task_index", "machine_id", "cpu_rate", "canonical_memory_usage", "assigned_memory_usage", "unmapped_page_cache", "total_page_cache",
    "maximum_memory_usage", "disk_io_time", "local_disk_space_usage", "maximum_cpu_rate", "maximum_disk_io_time", "cycles_per_instruction", "memory_accesses_per_instruction", "sample_portion", "aggregation_type", "sampled_cpu_usage",
)


def _ns(c: Column, unit: str) -> Column:
    if unit not in UNITS:
        raise Unsupported(f"time unit {unit}", "not one of " + ", ".join(UNITS))
    return F.round(c.cast("double") * UNITS[unit]).cast("long") if unit != "ns" else c.cast("long")


def _finite(df: DataFrame, value: str) -> DataFrame:
    """A value that is NaN or infinite is an error: it would poison sums without a trace."""
    v = F.col(value)
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    return df.withColumn(value, F.when(bad, F.raise_error(F.lit(f"{value} isn't finite")).cast("double")).otherwise(v))


def read_csv(spark: SparkSession, path: str, labels: Sequence[str], value: str, time: str, unit: str = "ms", end: str | None = None) -> DataFrame:
    """A CSV with a header, plain or .gz: its label columns, start_ns (and end_ns), value. Columns by name, all read as text and cast."""
    df = spark.read.option("header", True).csv(path)
    need = [*labels, value, time, *([end] if end else [])]
    if missing := set(need) - set(df.columns):
        raise Unsupported(f"columns {sorted(missing)}", "the file doesn't have them")
    stop = [_ns(F.col(end), unit).alias("end_ns")] if end else []
    return _finite(df.select(*labels, _ns(F.col(time), unit).alias("start_ns"), *stop, F.col(value).cast("double").alias("value")), "value")


def read_task_usage(spark: SparkSession, path: str, value: str = "cpu_rate", labels: Sequence[str] = ("job_id", "task_index")) -> DataFrame:
    """Task usage CSVs: 20 columns without header, times in microseconds."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in TASK_USAGE])
    df = spark.read.schema(schema).csv(path)
    return _finite(df.select(*labels, _ns(F.col("start_time"), "us").alias("start_ns"), _ns(F.col("end_time"), "us").alias("end_ns"), F.col(value).cast("double").alias("value")), "value")


def frequency_ns(freq: str) -> int:
    """S, T or min, H, D, with a count before it if it isn't one."""
    m = re.fullmatch(r"(\d*)(S|T|min|H|D)", freq)
    if not m:
        raise Unsupported(f"frequency {freq}", "not a count of S, T, min, H or D")
    return int(m[1] or 1) * {"S": 1, "T": 60, "min": 60, "H": 3600, "D": 86400}[m[2]] * UNITS["s"]


def explode_targets(df: DataFrame) -> DataFrame:
    """Rows (start timestamp, freq string, target array of doubles, or of arrays: one for each variate) -> (variate, start_ns, value)."""
    nested = isinstance(df.schema["target"].dataType.elementType, T.ArrayType)
    count, unit = F.regexp_extract("freq", r"^(\d*)(S|T|min|H|D)$", 1), F.regexp_extract("freq", r"^(\d*)(S|T|min|H|D)$", 2)
    seconds = F.when(unit == "S", 1).when(unit.isin("T", "min"), 60).when(unit == "H", 3600).when(unit == "D", 86400).otherwise(F.raise_error(F.concat(F.lit("frequency "), "freq")).cast("int"))
    step = F.when(count == "", F.lit("1")).otherwise(count).cast("long") * seconds * UNITS["s"]
    rows = df.select(F.unix_micros(F.col("start").cast("timestamp")).alias("at"), step.alias("step"), F.posexplode("target").alias("variate", "target") if nested else F.col("target"))
    rows = rows if nested else rows.withColumn("variate", F.lit(0))
    points = rows.select("variate", "at", "step", F.posexplode("target").alias("i", "value"))
    return _finite(points.select("variate", (F.col("at") * 1000 + F.col("i") * F.col("step")).alias("start_ns"), F.col("value").cast("double")), "value")


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files of start, freq, target, at a path that Spark reads; each is one row or few, and is read by a task, not the driver."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                t = pa.ipc.open_file(pa.BufferReader(content.as_buffer())).read_all().select(["start", "freq", "target"])
                target = t.column("target").combine_chunks()
                nested = pa.types.is_list(target.type.value_type) or pa.types.is_large_list(target.type.value_type)
                rows = [x if nested else [x] for x in target.to_pylist()]  # one series is one variate
                start = pa.array([str(x) for x in t.column("start").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([start, t.column("freq").combine_chunks().cast(pa.string()), pa.array(rows, pa.list_(pa.list_(pa.float64())))], ["start", "freq", "target"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return explode_targets(files.mapInArrow(tables, "start string, freq string, target array<array<double>>"))


def within(df: DataFrame, start_ns: int, end_ns: int, min_records: int = 1) -> DataFrame:
    """Points in [start, end), or intervals that lie wholly inside; fewer than ``min_records`` are an error."""
    stop = (F.col("end_ns") <= end_ns) if "end_ns" in df.columns else (F.col("start_ns") < end_ns)
    kept = df.filter((F.col("start_ns") >= start_ns) & stop)
    if kept.limit(min_records).count() < min_records:
        raise Unsupported(f"window {start_ns}..{end_ns}", f"fewer than {min_records} records in it")
    return kept


def as_samples(df: DataFrame, origin_ns: int, duration_ms: int, time_scale: float = 1.0) -> DataFrame:
    """ts_ms = 1 + the whole milliseconds since the origin, times time_scale; those beyond the duration go."""
    at = 1 + F.floor((F.col("start_ns") - origin_ns) * (time_scale / 1e6))
    return df.withColumn("ts_ms", at.cast("long")).filter((F.col("ts_ms") >= 1) & (F.col("ts_ms") <= duration_ms)).drop("start_ns", "end_ns")


def write_record(df: DataFrame, path: str, flat: bool = False) -> None:
    """JSON lines; flat: struct columns become columns of their own."""
    if flat:
        cols = [F.col(f"{f.name}.{g.name}").alias(f"{f.name}_{g.name}") if g else F.col(f.name) for f in df.schema for g in (f.dataType.fields if isinstance(f.dataType, T.StructType) else [None])]
        df = df.select(*cols)
    df.write.mode("overwrite").json(path)
