"""Panes: tumbling windows that are stored once and merged for any range made of them.

A pane ends at window_end = ((ts - 1) div width + 1) * width and holds mergeable
state for each label combination: n, sum, least, largest, first and last sample,
and what the counter stood at before each drop. A range that is a multiple of the
width, evaluated at multiples of it, reads panes instead of samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Unsupported
from ..operators.windows import Grid, extrapolated, windowed


def window_end(ts: Column, width: int) -> Column:
    return ((F.floor((ts - 1) / F.lit(float(width))) + 1) * width).cast("long")


STATE = ("n", "total", "least", "largest", "first_ms", "first", "last_ms", "last", "dropped")


def build(samples: DataFrame, width: int, labels: Sequence[str], ts: str = "ts_ms", value: str = "value") -> DataFrame:
    """(window_end, labels, state): one row for each pane and label combination."""
    rows = samples.withColumn("window_end", window_end(F.col(ts), width))
    w = W.partitionBy("window_end", *labels).orderBy(ts, value)
    rows = rows.withColumn("_before", F.lag(value).over(w))
    v, at = F.col(value), F.struct(F.col(ts), F.col(value))
    return rows.groupBy("window_end", *labels).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("largest"), F.min(ts).alias("first_ms"), F.min_by(v, at).alias("first"),
        F.max(ts).alias("last_ms"), F.max_by(v, at).alias("last"), F.sum(F.when(v < F.col("_before"), F.col("_before")).otherwise(0.0)).alias("dropped"),
    )


def _state(*keys: str) -> list[Column]:
    """Merged state; needs _seam, the drop between a pane and the one before it."""
    return [
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("largest").alias("largest"), F.min("first_ms").alias("first_ms"),
        F.min_by("first", F.struct("first_ms", "first")).alias("first"), F.max("last_ms").alias("last_ms"), F.max_by("last", F.struct("last_ms", "last")).alias("last"),
        (F.sum("dropped") + F.sum("_seam")).alias("dropped"),
    ]


def _seams(panes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """With _seam; panes of one series that overlap in time are an error."""
    w = W.partitionBy(*keys).orderBy("first_ms", "last_ms")
    before, until = F.lag("last").over(w), F.lag("last_ms").over(w)
    seam = F.when(until > F.col("first_ms"), F.raise_error(F.lit("stored panes overlap")).cast("double")).when(F.col("first") < before, before).otherwise(0.0)
    return panes.withColumn("_seam", seam)


def roll_up(panes: DataFrame, width: int, labels: Sequence[str]) -> DataFrame:
    """Wider panes from narrower ones."""
    wider = panes.withColumn("window_end", window_end(F.col("window_end"), width))
    return _seams(wider, ["window_end", *labels]).groupBy("window_end", *labels).agg(*_state())


def merge(panes: DataFrame, width: int, grid: Grid, range_ms: int, labels: Sequence[str]) -> DataFrame:
    """(t, labels, state) over each (t - range, t]: the range and every t must be multiples of the panes' width."""
    if range_ms % width or grid.first % width or grid.step % width:
        raise Unsupported(f"range {range_ms} at {grid.first} + n * {grid.step}", f"panes are {width} wide")
    return _seams(windowed(panes, grid, range_ms, "window_end"), ["t", *labels]).groupBy("t", *labels).agg(*_state())


def regroup(state: DataFrame, by: Sequence[str]) -> DataFrame:
    """State by fewer labels: sums of n and total, and the least and largest; the order of samples is gone."""
    return state.groupBy("t", *by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("largest").alias("largest"))


def increase_of(state: DataFrame, range_ms: int, labels: Sequence[str], per_second: bool = False) -> DataFrame:
    """The same as from samples, since drops within and between panes are kept."""
    inc = F.col("last") - F.col("first") + F.col("dropped")
    out = extrapolated(F.col("n"), F.col("first_ms"), F.col("last_ms"), F.col("first"), inc, F.col("t"), range_ms)
    return state.select("t", *labels, (out / (range_ms / 1000.0) if per_second else out).alias("value")).filter("value IS NOT NULL")


def retain(panes: DataFrame, now_ms: int, retention_ms: int) -> DataFrame:
    return panes.filter(F.col("window_end") > now_ms - retention_ms)
