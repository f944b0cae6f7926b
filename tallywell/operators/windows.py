"""Windowed time-series queries over samples, for many evaluation times in one job.

A sample is (labels..., ts_ms, value). The window of an evaluation time t and
range r is (t - r, t], open on the left. Every evaluation is a group of the same
plan: each sample is sent to the grid times whose windows hold it, which is
arithmetic on its time and not a join. When the range and the step share a large
divisor, panes (plans/panes.py) hold far less.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Unsupported
from .exact import quantiles


@dataclass(frozen=True)
class Grid:
    """Evaluation times first, first + step, ..., up to last."""

    first: int
    last: int
    step: int

    @staticmethod
    def after_warmup(start: int, end: int, window: int, step: int) -> Grid:
        """The first time is start + window rounded up to the step."""
        return Grid(-(-(start + window) // step) * step, end, step)


def windowed(samples: DataFrame, grid: Grid, range_ms: int, ts: str = "ts_ms") -> DataFrame:
    """Each sample once for each evaluation time t with t - range_ms < ts <= t, in a new column t.

    The bounds on ts are a plain range on the stored column, so that they reach the scan.
    """
    inside = samples.filter((F.col(ts) > grid.first - range_ms) & (F.col(ts) <= grid.last))
    low = F.greatest(F.lit(0), F.ceil((F.col(ts) - grid.first) / F.lit(float(grid.step)))).cast("long")
    high = F.least(F.lit((grid.last - grid.first) // grid.step), F.ceil((F.col(ts) + range_ms - grid.first) / F.lit(float(grid.step))) - 1).cast("long")
    steps = inside.withColumn("_low", low).withColumn("_high", high).filter("_low <= _high")
    return steps.withColumn("t", F.explode(F.sequence("_low", "_high"))).withColumn("t", F.lit(grid.first) + F.col("t") * grid.step).drop("_low", "_high")


_OVER = {
    "sum": lambda v, ts: F.sum(v), "count": lambda v, ts: F.count(v).cast("double"), "min": lambda v, ts: F.min(v), "max": lambda v, ts: F.max(v),
    "avg": lambda v, ts: F.avg(v), "distinct": lambda v, ts: F.countDistinct(v).cast("double"), "last": lambda v, ts: F.max_by(v, ts),
}


def over_time(samples: DataFrame, grid: Grid, range_ms: int, how: str, labels: Sequence[str], ts: str = "ts_ms", value: str = "value") -> DataFrame:
    """(t, labels, value) per series: sum, count, min, max, avg, distinct, last or entropy (base 2, of the values) over each window."""
    if how not in (*_OVER, "entropy"):
        raise Unsupported(f"{how}_over_time", "not one of " + ", ".join([*_OVER, "entropy"]))
    rows = windowed(samples, grid, range_ms, ts)
    if how == "entropy":
        n = F.col("n").cast("double")
        counts = rows.groupBy("t", *labels, value).agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("t", *labels).agg((F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("value"))
    return rows.groupBy("t", *labels).agg(_OVER[how](F.col(value), F.col(ts)).alias("value"))


def quantile_over_time(samples: DataFrame, grid: Grid, range_ms: int, q: float, labels: Sequence[str], ts: str = "ts_ms", value: str = "value") -> DataFrame:
    """(t, labels, value) with the linear rule."""
    return quantiles(windowed(samples, grid, range_ms, ts), value, [q], by=["t", *labels]).drop("q")


def instant(samples: DataFrame, grid: Grid, lookback_ms: int, labels: Sequence[str], ts: str = "ts_ms", value: str = "value") -> DataFrame:
    """(t, labels, value): each series' latest sample in the lookback; none, no row."""
    return over_time(samples, grid, lookback_ms, "last", labels, ts, value)


def extrapolated(n: Column, first_ms: Column, last_ms: Column, first: Column, increase: Column, t: Column, range_ms: int) -> Column:
    """The increase over the whole range, from the increase between its first and last samples.

    Each end is extended by its distance to the range's end, or by half the mean gap
    where that is 1.1 gaps or more away; not before a counter would be zero.
    """
    sampled = (last_ms - first_ms) / 1000.0
    gap = sampled / (n - 1)
    to_start, to_end = (first_ms - (t - range_ms)) / 1000.0, (t - last_ms) / 1000.0
    start = F.when(to_start >= gap * 1.1, gap / 2).otherwise(to_start)
    zero = F.when((increase > 0) & (first >= 0), sampled * first / increase).otherwise(start)
    end = F.when(to_end >= gap * 1.1, gap / 2).otherwise(to_end)
    return F.when((n >= 2) & (sampled > 0), increase * (sampled + F.least(start, zero) + end) / sampled)


def increase_over(samples: DataFrame, grid: Grid, range_ms: int, labels: Sequence[str], per_second: bool = False, ts: str = "ts_ms", value: str = "value") -> DataFrame:
    """(t, labels, value): extrapolated increase, or rate, of counters; series with fewer than two samples in a window give no row.

    What a counter stood at before each drop is added back. Samples of one time are in the order of their values.
    """
    rows = windowed(samples, grid, range_ms, ts)
    w = W.partitionBy("t", *labels).orderBy(ts, value)
    stepped = rows.withColumn("_before", F.lag(value).over(w))
    v, at = F.col(value), F.struct(F.col(ts), F.col(value))
    got = stepped.groupBy("t", *labels).agg(
        F.count(v).alias("_n"), F.min(ts).alias("_a"), F.max(ts).alias("_b"), F.min_by(v, at).alias("_first"),
        (F.max_by(v, at) - F.min_by(v, at) + F.sum(F.when(v < F.col("_before"), F.col("_before")).otherwise(0.0))).alias("_inc"),
    )
    out = extrapolated(F.col("_n"), F.col("_a"), F.col("_b"), F.col("_first"), F.col("_inc"), F.col("t"), range_ms)
    return got.select("t", *labels, (out / (range_ms / 1000.0) if per_second else out).alias("value")).filter("value IS NOT NULL")


def aggregate(vector: DataFrame, how: str, by: Sequence[str] = (), q: float | None = None) -> DataFrame:
    """sum, avg, min, max, count or quantile of a vector by labels; an empty vector gives no row, even without labels."""
    if how == "quantile":
        return quantiles(vector, "value", [q], by=["t", *by]).drop("q")
    f = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": lambda v: F.count(v).cast("double")}.get(how)
    if f is None:
        raise Unsupported(f"aggregation {how}", "not one of sum, avg, min, max, count, quantile")
    return vector.groupBy("t", *by).agg(f("value").alias("value"))


def topk(vector: DataFrame, k: int, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The k largest values at each t (and by labels), with all labels; NaN is below every number, ties by labels ascending."""
    value = F.col("value")
    w = W.partitionBy("t", *by).orderBy(F.isnan(value), F.desc("value"), *[F.asc(c) for c in labels])
    return vector.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def binary(left: DataFrame, op: str, right: DataFrame, labels: Sequence[str] = (), finite: bool = False) -> DataFrame:
    """left op right, one to one on t and all labels. finite: a result that isn't finite is an error."""
    a, b = F.col("a"), F.col("b")
    f = {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}.get(op)
    if f is None:
        raise Unsupported(f"operator {op}", "not one of + - * /")
    if op == "/":
        f = F.when(b != 0, f).otherwise(F.when(a.isNull() | b.isNull(), None).when((a == 0) | F.isnan(a), float("nan")).when((a > 0) == (F.signum(b) >= 0), float("inf")).otherwise(float("-inf")))
    if finite:
        f = F.when(F.isnan(f) | (F.abs(f) == float("inf")), F.raise_error(F.lit("division has no finite result")).cast("double")).otherwise(f)
    keys = ["t", *labels]
    return left.select(*keys, F.col("value").alias("a")).join(right.select(*keys, F.col("value").alias("b")), keys).select(*keys, f.alias("value"))


def count_distinct_labels(samples: DataFrame, grid: Grid, range_ms: int, label: str, ts: str = "ts_ms") -> DataFrame:
    """count(count by (label) (count_over_time(...))): how many values a label has in each window."""
    return windowed(samples, grid, range_ms, ts).groupBy("t").agg(F.countDistinct(label).cast("double").alias("value"))


def labelled(samples: DataFrame, **match: str) -> DataFrame:
    """Samples whose labels equal those given; '' matches an absent label."""
    for k, v in match.items():
        samples = samples.filter(F.col(k) == v if v else F.coalesce(F.col(k), F.lit("")) == "")
    return samples
