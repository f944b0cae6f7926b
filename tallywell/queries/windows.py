"""Windowed time-series queries over events: series are (event_type, user_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows as V
from ..plans import panes as P
from . import query, table

HOUR, DAY = 3_600_000, 86_400_000
SERIES = ["event_type", "user_id"]


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """ts_ms is made from the stored timestamp; a table kept for this use stores it, so that range filters reach the scan."""
    e = table(spark, sf, "events")
    return e.select("event_type", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "value")


def bounds(spark: SparkSession, sf: str) -> tuple[int, int]:
    """The first and the last time of all samples; with none, an empty range."""
    lo, hi = samples(spark, sf).agg(F.min("ts_ms"), F.max("ts_ms")).first()
    return (1, 0) if lo is None else (lo, hi)


def grid(spark: SparkSession, sf: str, range_ms: int, step: int = DAY) -> V.Grid:
    """Evaluations at multiples of ``step``, from the first whose window is warm, or all but warm, to the first at or after the
    last sample: with a range of a step or more, every sample is in a window."""
    lo, hi = bounds(spark, sf)
    return V.Grid((lo - 1 + range_ms) // step * step, -(-hi // step) * step, step)


def times_sql(range_ms: int, step: int = DAY) -> str:
    return f"times AS (SELECT unnest(range((SELECT (min(ts_ms) - 1 + {range_ms}) // {step} * {step} FROM s), (SELECT (max(ts_ms) + {step} - 1) // {step} * {step} FROM s) + 1, {step}))::BIGINT AS t)"


_S = "s AS (SELECT event_type, user_id, epoch_us(ts) // 1000 AS ts_ms, value FROM events)"


def _with(r: int, step: int = DAY) -> str:
    return f"WITH {_S}, {times_sql(r, step)}, w AS (SELECT t, s.* FROM s, times WHERE ts_ms > t - {r} AND ts_ms <= t)"


def _round(df: DataFrame, n: int = 6) -> DataFrame:
    return df.withColumn("value", F.round("value", n))


for _how, _sql in {"sum": "sum(value)", "count": "count(*)::DOUBLE", "min": "min(value)", "max": "max(value)", "avg": "avg(value)", "distinct": "count(DISTINCT value)::DOUBLE"}.items():

    @query(_with(2 * DAY) + f" SELECT t, event_type, user_id, round({_sql}, 6) AS value FROM w GROUP BY ALL", name=f"{_how}_over_time")
    def _over(spark, sf, how=_how):
        return _round(V.over_time(samples(spark, sf), grid(spark, sf, 2 * DAY), 2 * DAY, how, SERIES))


@query(_with(10 * DAY) + ", c AS (SELECT t, event_type, floor(value / 50) AS v, count(*) AS n FROM w GROUP BY ALL), d AS (SELECT *, sum(n) OVER (PARTITION BY t, event_type)::DOUBLE AS s FROM c) SELECT t, event_type, round(-sum(n / s * log2(n / s)), 6) AS value FROM d GROUP BY ALL")
def entropy_over_time(spark, sf):
    s = samples(spark, sf).withColumn("value", F.floor(F.col("value") / 50).cast("double"))
    return _round(V.over_time(s, grid(spark, sf, 10 * DAY), 10 * DAY, "entropy", ["event_type"]))


@query(_with(5 * DAY) + " SELECT t, event_type, round(quantile_cont(value, 0.95), 6) AS value FROM w GROUP BY ALL")
def quantile_over_time(spark, sf):
    return _round(V.quantile_over_time(samples(spark, sf), grid(spark, sf, 5 * DAY), 5 * DAY, 0.95, ["event_type"]))


_RATE = """, l AS (SELECT *, lag(value) OVER (PARTITION BY t, event_type, user_id ORDER BY ts_ms, value) AS b FROM w),
    g AS (SELECT t, event_type, user_id, count(*) AS n, min(ts_ms) AS a, max(ts_ms) AS z, arg_min(value, (ts_ms, value)) AS f,
                 arg_max(value, (ts_ms, value)) - arg_min(value, (ts_ms, value)) + sum(CASE WHEN value < b THEN b ELSE 0 END) AS inc FROM l GROUP BY ALL HAVING count(*) >= 2 AND max(ts_ms) > min(ts_ms)),
    h AS (SELECT *, (z - a) / 1000.0::DOUBLE AS sm, (z - a) / 1000.0::DOUBLE / (n - 1) AS gap, (a - (t - {r})) / 1000.0::DOUBLE AS ts0, (t - z) / 1000.0::DOUBLE AS te FROM g),
    k AS (SELECT *, CASE WHEN ts0 >= gap * 1.1::DOUBLE THEN gap / 2 ELSE ts0 END AS ds, CASE WHEN te >= gap * 1.1::DOUBLE THEN gap / 2 ELSE te END AS de FROM h),
    x AS (SELECT t, event_type, user_id, inc * (sm + least(ds, CASE WHEN inc > 0 AND f >= 0 THEN sm * f / inc ELSE ds END) + de) / sm AS increase FROM k)"""


@query(_with(10 * DAY) + _RATE.format(r=10 * DAY) + " SELECT t, event_type, round(sum(increase / 864000.0::DOUBLE), 9) AS value FROM x GROUP BY ALL")
def rate_sum_by_type(spark, sf):
    return _round(V.aggregate(V.increase_over(samples(spark, sf), grid(spark, sf, 10 * DAY), 10 * DAY, SERIES, True), "sum", ["event_type"]), 9)


@query(_with(5 * DAY) + _RATE.format(r=5 * DAY) + " SELECT t, event_type, user_id, round(increase, 6) AS value FROM x")
def increase_per_series(spark, sf):
    return _round(V.increase_over(samples(spark, sf), grid(spark, sf, 5 * DAY), 5 * DAY, SERIES))


@query(_with(6 * HOUR) + " SELECT t, event_type, user_id, arg_max(value, ts_ms) AS value FROM w GROUP BY ALL")
def instant_selector(spark, sf):
    return V.instant(samples(spark, sf), grid(spark, sf, 6 * HOUR), 6 * HOUR, SERIES)


@query(_with(6 * HOUR) + ", v AS (SELECT t, event_type, user_id, arg_max(value, ts_ms) AS value FROM w GROUP BY ALL) SELECT t, event_type, round(sum(value), 6) AS value FROM v GROUP BY ALL")
def sum_of_instant(spark, sf):
    return _round(V.aggregate(V.instant(samples(spark, sf), grid(spark, sf, 6 * HOUR), 6 * HOUR, SERIES), "sum", ["event_type"]))


@query(_with(3 * DAY) + ", v AS (SELECT t, event_type, user_id, max(value) AS value FROM w GROUP BY ALL) SELECT t, event_type, round(quantile_cont(value, 0.9), 6) AS value FROM v GROUP BY ALL")
def quantile_by_type(spark, sf):
    return _round(V.aggregate(V.over_time(samples(spark, sf), grid(spark, sf, 3 * DAY), 3 * DAY, "max", SERIES), "quantile", ["event_type"], 0.9))


@query(_with(3 * DAY) + ", q AS (SELECT t, event_type, user_id, quantile_cont(value, 0.5) AS value FROM w GROUP BY ALL) SELECT t, event_type, round(avg(value), 10) AS value FROM q GROUP BY ALL")
def avg_of_quantile(spark, sf):
    return _round(V.aggregate(V.quantile_over_time(samples(spark, sf), grid(spark, sf, 3 * DAY), 3 * DAY, 0.5, SERIES), "avg", ["event_type"]), 10)


_TOP = ", v AS (SELECT t, event_type, user_id, sum(value) AS value FROM w GROUP BY ALL) SELECT t, event_type, user_id, round(value, 6) AS value FROM v QUALIFY row_number() OVER (PARTITION BY t{by} ORDER BY value DESC, event_type, user_id) <= {k}"


@query(_with(DAY) + _TOP.format(by="", k=10))
def topk_global(spark, sf):
    return _round(V.topk(V.over_time(samples(spark, sf), grid(spark, sf, DAY), DAY, "sum", SERIES), 10, SERIES))


@query(_with(DAY) + _TOP.format(by=", event_type", k=3))
def topk_by_type(spark, sf):
    return _round(V.topk(V.over_time(samples(spark, sf), grid(spark, sf, DAY), DAY, "sum", SERIES), 3, SERIES, ["event_type"]))


@query(_with(2 * DAY) + ", a AS (SELECT t, user_id, sum(value) AS v FROM w WHERE event_type = 'error' GROUP BY ALL), b AS (SELECT t, user_id, sum(value) AS v FROM w GROUP BY ALL) SELECT t, user_id, round(a.v / b.v, 9) AS value FROM a JOIN b USING (t, user_id)")
def binop_ratio(spark, sf):
    """The share of errors in each user's sum; NaN, as in SQL, where all of a window's values are 0."""
    s = samples(spark, sf)
    part = V.over_time(V.labelled(s, event_type="error"), grid(spark, sf, 2 * DAY), 2 * DAY, "sum", ["user_id"])
    return _round(V.binary(part, "/", V.over_time(s, grid(spark, sf, 2 * DAY), 2 * DAY, "sum", ["user_id"]), ["user_id"]), 9)


@query(_with(2 * DAY) + ", a AS (SELECT t, sum(value) AS v FROM w WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT t, sum(value) AS v FROM w WHERE event_type = 'view' GROUP BY ALL) SELECT t, round((a.v - b.v) * (a.v + b.v), 5) AS value FROM a JOIN b USING (t)")
def binop_nested_global(spark, sf):
    s = samples(spark, sf)
    a, b = (V.aggregate(V.over_time(V.labelled(s, event_type=x), grid(spark, sf, 2 * DAY), 2 * DAY, "sum", ["user_id"]), "sum") for x in ("click", "view"))
    return _round(V.binary(V.binary(a, "-", b), "*", V.binary(a, "+", b)), 5)


@query(_with(DAY) + " SELECT t, count(DISTINCT user_id)::DOUBLE AS value FROM w GROUP BY ALL")
def count_distinct_idiom(spark, sf):
    return V.count_distinct_labels(samples(spark, sf), grid(spark, sf, DAY), DAY, "user_id")


@query(_with(7 * HOUR, 2 * HOUR) + " SELECT t, event_type, round(sum(value), 6) AS value FROM w GROUP BY ALL")
def sliding_eval_grid(spark, sf):
    return _round(V.over_time(samples(spark, sf), grid(spark, sf, 7 * HOUR, 2 * HOUR), 7 * HOUR, "sum", ["event_type"]))


_PANE = "WITH " + _S + f", p AS (SELECT ((ts_ms - 1) // {HOUR} + 1) * {HOUR} AS window_end, event_type, user_id, value, ts_ms FROM s)"


@query(_PANE + " SELECT window_end, event_type, user_id, count(*) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS largest FROM p GROUP BY ALL")
def pane_build(spark, sf):
    return P.build(samples(spark, sf), HOUR, SERIES).select("window_end", *SERIES, "n", F.round("total", 6).alias("total"), "least", "largest")


@query(_with(2 * DAY) + " SELECT t, event_type, user_id, count(*) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS largest FROM w GROUP BY ALL")
def pane_merge(spark, sf):
    merged = P.merge(P.build(samples(spark, sf), HOUR, SERIES), HOUR, grid(spark, sf, 2 * DAY), 2 * DAY, SERIES)
    return merged.select("t", *SERIES, F.col("n"), F.round("total", 6).alias("total"), "least", "largest")


@query(_with(2 * DAY) + " SELECT t, event_type, count(*) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS largest FROM w GROUP BY ALL")
def pane_regroup(spark, sf):
    merged = P.merge(P.build(samples(spark, sf), HOUR, SERIES), HOUR, grid(spark, sf, 2 * DAY), 2 * DAY, SERIES)
    return P.regroup(merged, ["event_type"]).withColumn("total", F.round("total", 6))


@query(_with(5 * DAY) + _RATE.format(r=5 * DAY) + " SELECT t, event_type, user_id, round(increase / 432000.0::DOUBLE, 11) AS value FROM x")
def pane_rate_stored(spark, sf):
    merged = P.merge(P.build(samples(spark, sf), HOUR, SERIES), HOUR, grid(spark, sf, 5 * DAY), 5 * DAY, SERIES)
    return _round(P.increase_of(merged, 5 * DAY, SERIES, True), 11)


@query(f"WITH {_S} SELECT ((ts_ms - 1) // {DAY} + 1) * {DAY} AS window_end, event_type, user_id, count(*) AS n, round(sum(value), 6) AS total, arg_min(value, (ts_ms, value)) AS first, arg_max(value, (ts_ms, value)) AS last FROM s GROUP BY ALL")
def pane_rollup_day_from_hour(spark, sf):
    return P.roll_up(P.build(samples(spark, sf), HOUR, SERIES), DAY, SERIES).select("window_end", *SERIES, "n", F.round("total", 6).alias("total"), "first", "last")


@query("SELECT NULL::BIGINT AS t, NULL::VARCHAR AS event_type, NULL::BIGINT AS user_id, NULL::DOUBLE AS value WHERE false")
def pane_vs_raw_diff(spark, sf):
    """Increases from panes that aren't those from samples: none."""
    s = samples(spark, sf)
    raw = _round(V.increase_over(s, grid(spark, sf, 5 * DAY), 5 * DAY, SERIES))
    return _round(P.increase_of(P.merge(P.build(s, HOUR, SERIES), HOUR, grid(spark, sf, 5 * DAY), 5 * DAY, SERIES), 5 * DAY, SERIES)).exceptAll(raw)


@query(f"WITH {_S}, p AS (SELECT DISTINCT ((ts_ms - 1) // {DAY} + 1) * {DAY} AS window_end, event_type FROM s) SELECT window_end, event_type FROM p WHERE window_end > (SELECT (max(ts_ms) + {DAY} - 1) // {DAY} * {DAY} FROM s) - {7 * DAY}")
def pane_retention(spark, sf):
    return P.retain(P.build(samples(spark, sf), DAY, ["event_type"]), grid(spark, sf, DAY).last, 7 * DAY).select("window_end", "event_type")
