"""Checks on sampled answers with intervals, under each policy; the exact plan answers open evaluations from the events of their windows alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import exact as E
from ..operators import rerun as N
from ..operators import stream_sketches as T
from ..operators import windows as V
from . import query, table
from .rules import _BASE, _DRAWN, _evaluations
from .windows import HOUR, grid

ERROR, SPAN = 0.15, 6 * HOUR


def _answers(spark, sf) -> DataFrame:
    return N.widened(_evaluations(spark, sf, True).select("entity", "t", F.col("v").alias("value")), "relative", ERROR)


def _rows(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("entity"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "value")


def _exact(spark, sf, how=lambda rows: rows.groupBy("entity", "t").agg(F.round(F.sum("value"), 6).alias("value"))):
    """The exact plan for some evaluations: samples of other windows are dropped where they are read."""
    g = grid(spark, sf, SPAN, HOUR)

    def answer(keys: DataFrame) -> DataFrame:
        return how(V.windowed(_rows(spark, sf), g, SPAN).join(keys, ["entity", "t"], "left_semi"))

    return answer


def _out(judged: DataFrame) -> DataFrame:
    return judged.select("entity", "t", "state", "open", "rerun")


#: Rounds of a check over all evaluations, until none that is open is new. x: the exact answer. {check}: of value, lo, hi in relation f.
_ROUNDS = _BASE.replace("WITH ", "WITH RECURSIVE ", 1) + """,
    base AS (SELECT a.entity, a.t, a.v, least(a.v / {up}, a.v / {down}) AS lo, greatest(a.v / {up}, a.v / {down}) AS hi, r.v AS x FROM a LEFT JOIN r USING (entity, t)),
    rounds AS (SELECT 0 AS round, entity, t, v, lo, hi, x, false AS rerun, false AS over FROM base UNION ALL
        SELECT round + 1, entity, t, CASE WHEN fresh THEN x ELSE v END, CASE WHEN fresh THEN x ELSE lo END, CASE WHEN fresh THEN x ELSE hi END, x, rerun OR fresh, NOT more FROM
            (SELECT *, c IS NULL AND NOT rerun AS fresh, bool_or(c IS NULL AND NOT rerun) OVER () AS more FROM ({check})) WHERE NOT over),
    f AS (SELECT * FROM rounds WHERE over),
    e AS (SELECT entity, t, v, v AS lo, v AS hi, rerun FROM (SELECT entity, t, x AS v, rerun FROM f))
    SELECT z.entity, z.t, coalesce(z.c, y.c, false) AS state, z.c IS NULL AS open, z.rerun FROM ({last}) z JOIN ({exact}) y USING (entity, t)"""


def _sql(check: str) -> str:
    return _ROUNDS.format(check=check.format(rel="rounds"), last=check.format(rel="f"), exact=check.format(rel="e"), up=f"(1 + {ERROR}::DOUBLE)", down=f"(1 - {ERROR}::DOUBLE)")


_GT = "CASE WHEN {n} THEN false WHEN lo IS NULL THEN false WHEN lo > {at} THEN true WHEN hi <= {at} THEN false END"
_BAND = f"SELECT *, {_GT.format(n='n < 24', at='m + 1.5::DOUBLE * sd')} AS c FROM (SELECT *, avg(v) OVER p AS m, stddev_pop(v) OVER p AS sd, count(v) OVER p AS n FROM {{rel}} WINDOW p AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))"


@query(_sql(_BAND))
def rerun_band(spark, sf):
    """A band over a day's history; what the intervals leave open is asked exactly, until nothing new is open."""
    return _out(N.judge(_answers(spark, sf), N.band(24, 1.5), "rerun", _exact(spark, sf)))


def _cusum_sql(rel: str) -> str:
    """The two sums by a fold over each entity's evaluations in order."""
    move = lambda s, end: f"CASE WHEN y.on_ THEN least(8 * y.sd, greatest(0.0::DOUBLE, s.{s} + y.{end} - y.m - 0.25::DOUBLE * y.sd)) ELSE s.{s} END"
    sums = f"struct_pack(sl := {move('sl', 'lo')}, sh := {move('sh', 'hi')})"
    step = f"struct_pack(sl := {move('sl', 'lo')}, sh := {move('sh', 'hi')}, lo := y.lo, hi := y.hi, on_ := y.on_, m := y.m, sd := y.sd, got := list_append(s.got, {sums}))"
    stats = "CASE WHEN count(CASE WHEN j <= 50 THEN v END) OVER e = 50 THEN {f}(CASE WHEN j <= 50 THEN v END) OVER e END"
    rows = f"SELECT *, {stats.format(f='avg')} AS m, {stats.format(f='stddev_pop')} AS sd FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t) AS j FROM {rel}) WINDOW e AS (PARTITION BY entity)"
    item = "struct_pack(sl := 0.0::DOUBLE, sh := 0.0::DOUBLE, lo := {lo}, hi := {hi}, on_ := {on}, m := {m}, sd := {sd}, got := []::STRUCT(sl DOUBLE, sh DOUBLE)[])"
    zero = item.format(lo="0.0::DOUBLE", hi="0.0::DOUBLE", on="false", m="0.0::DOUBLE", sd="0.0::DOUBLE")
    each = item.format(lo="lo", hi="hi", on="j > 50 AND v IS NOT NULL AND m IS NOT NULL", m="m", sd="sd")
    folded = f"SELECT *, list_reduce(list({each}) OVER (PARTITION BY entity ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), lambda s, y: {step}, {zero}).got AS got FROM ({rows})"
    return f"SELECT * EXCLUDE (j, m, sd, got), CASE WHEN j <= 50 OR v IS NULL OR m IS NULL THEN false WHEN got[j].sl > 4 * sd THEN true WHEN got[j].sh <= 4 * sd THEN false END AS c FROM ({folded})"


@query(_ROUNDS.format(check=_cusum_sql("rounds"), last=_cusum_sql("f"), exact=_cusum_sql("e"), up=f"(1 + {ERROR}::DOUBLE)", down=f"(1 - {ERROR}::DOUBLE)"))
def rerun_cusum(spark, sf):
    """A lower and an upper cumulative sum; what stays open after its rerun takes the exact arm's check."""
    return _out(N.judge(_answers(spark, sf), N.cusum(50, 0.25, 4), "rerun", _exact(spark, sf)))


@query(f"""{_BASE}, c AS (SELECT entity, t, v / (1 + {ERROR}::DOUBLE) > 900 AS yes, v / (1 - {ERROR}::DOUBLE) <= 900 AS no FROM a), d AS (SELECT c.*, NOT yes AND NOT no AS rerun, r.v > 900 AS x FROM c LEFT JOIN r USING (entity, t))
    SELECT entity, count(*) AS evaluations, count(*) FILTER (rerun) AS reruns, 0::BIGINT AS open, round(avg((coalesce(x, false) = CASE WHEN rerun THEN coalesce(x, false) ELSE yes END)::INT), 9) AS agreement FROM d GROUP BY entity""")
def rerun_threshold_summary(spark, sf):
    """How many evaluations of each entity were asked exactly, and how often the settled arm decides as the exact one does."""
    judged = N.judge(_answers(spark, sf), N.threshold(900), "rerun", _exact(spark, sf))
    truth = _evaluations(spark, sf).select("entity", "t", (F.col("v") > 900).alias("state"))
    return N.summary(judged, truth, ["entity"]).withColumn("agreement", F.round("agreement", 9))


PHI, RANK = 0.9, 0.05
_Q = f"""{_BASE}, g AS (SELECT event_type AS entity, t, round(quantile_cont(value, {PHI}), 6) AS v, round(quantile_cont(value, {PHI - RANK:g}), 6) AS lo, round(quantile_cont(value, {PHI + RANK:g}), 6) AS hi FROM w WHERE {{drawn}} GROUP BY ALL),
    e AS (SELECT event_type AS entity, t, round(quantile_cont(value, {PHI}), 6) AS x FROM w GROUP BY ALL),
    h AS (SELECT g.entity, g.t, least(lo, v) AS lo, greatest(hi, v) AS hi, x FROM g LEFT JOIN e USING (entity, t)), c AS (SELECT *, CASE WHEN lo > 150 THEN true WHEN hi <= 150 THEN false END AS c FROM h)
    SELECT entity, t, coalesce(c, x > 150, false) AS state, false AS open, c IS NULL AS rerun FROM c"""


@query(_Q.format(drawn=_DRAWN))
def rerun_quantile(spark, sf):
    """A 0.9-quantile of sampled values; its companions at 0.85 and 0.95, read from the same sample, are the interval."""
    s = T.sampled(_rows(spark, sf), F.col("event_id"), 0.2)
    rows = V.windowed(s, grid(spark, sf, SPAN, HOUR), SPAN)
    read = E.quantiles(rows, "value", N.companion_ranks(PHI, RANK), by=["entity", "t"]).withColumn("value", F.round("value", 6))
    answers, companions = N.from_quantiles(read, PHI, RANK)
    exact = _exact(spark, sf, lambda w: E.quantiles(w, "value", [PHI], by=["entity", "t"]).select("entity", "t", F.round("value", 6).alias("value")))
    return _out(N.judge(N.widened(answers, "rank", RANK, companions), N.threshold(150), "rerun", exact))
