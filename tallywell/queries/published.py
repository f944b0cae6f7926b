"""Published rules over hourly evaluations of events, with levels that these tables reach; the evaluations are scaled to the rules' units."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import published as U
from . import query
from .rules import _BASE, _evaluations

_RECURSIVE = _BASE.replace("WITH ", "WITH RECURSIVE ", 1)


def _any(rules: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS rule, entity, t, coalesce({state}, false) AS state FROM {of}" for name, (state, of) in rules.items())


def _last(flag: str, n: int) -> str:
    return f"sum(coalesce({flag}, false)::INT) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _band(name: str, of: str, value: str, size: int) -> str:
    return f"{name} AS (SELECT *, avg({value}) OVER p AS c, stddev_pop({value}) OVER p AS sd, count({value}) OVER p AS n FROM {of} WINDOW p AS (PARTITION BY entity ORDER BY t ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING))"


def _latch(name: str, of: str, hit: str, n: int, held: bool = False) -> str:
    """name(entity, i, remain, state): on for n evaluations from a hit while off."""
    again = "WHEN h.state AND hit THEN 0 " if held else ""
    return f"""{name} AS (SELECT DISTINCT entity, 0::BIGINT AS i, 0::BIGINT AS remain, false AS state FROM {of} UNION ALL
        SELECT entity, i, CASE WHEN remain > 0 THEN remain - 1 {again}WHEN hit THEN {n - 1} ELSE 0 END, remain > 0 OR hit FROM (SELECT h.entity, o.i, h.remain, h.state, coalesce({hit}, false) AS hit FROM {name} h JOIN {of} o ON o.entity = h.entity AND o.i = h.i + 1) h)"""


_NUMBERED = "o AS (SELECT *, v / 100 AS x, row_number() OVER (PARTITION BY entity ORDER BY t) AS i FROM r)"
_FLOOD = dict(entropy=9.5, distinct=17, distinct_short=16, history=24, sigmas=2, factor=1.2, training=50, slack=0.5, alarm=5, packets_per_s=240, ban_s=60, flows_per_s=13 / 60, for_s=10, step_s=5)


@query(f"""{_RECURSIVE}, {_NUMBERED}, {_band('b', 'o', 'd', 24)},
    k AS (SELECT entity, avg(x) AS m, stddev_pop(x) AS sd FROM o WHERE i <= 50 GROUP BY entity HAVING count(x) = 50),
    c AS (SELECT entity, 50::BIGINT AS i, 0.0::DOUBLE AS s FROM k UNION ALL SELECT entity, o.i, least(10 * sd, greatest(0, s + x - m - 0.5::DOUBLE * sd)) FROM c JOIN k USING (entity) JOIN o USING (entity) WHERE o.i = c.i + 1),
    cs AS (SELECT entity, t, o.i > 50 AND s > 5 * sd AS alarm FROM o LEFT JOIN c USING (entity, i) LEFT JOIN k USING (entity)),
    {_latch('l', 'o', 'v > 1200', 12, True)}, ls AS (SELECT entity, t, state FROM l JOIN o USING (entity, i))
    {_any({
        "promsketch_for_15s": (_last("x > 9.5 OR d > 16", 3) + " >= 3", "o"), "datadog": ("n >= 24 AND d > c + 2 * sd", "b"),
        "kentik": (_last("n >= 24 AND d > 1.2::DOUBLE * c", 6) + " >= 3", "b"), "netflow_logic": ("alarm", "cs"), "fastnetmon": ("state", "ls"), "red_hat": (_last("d > 13", 3) + " >= 3", "o"),
    })}""")
def rules_syn_flood(spark, sf):
    e = _evaluations(spark, sf).select("entity", "t", (F.col("v") / 100).alias("entropy_10s"), F.col("d").alias("distinct_10s"), F.col("d").alias("distinct_5s"), F.col("v").alias("packets_5s"), F.col("d").alias("distinct_1m"))
    return U.judged(e, U.answerable(U.syn_flood(**_FLOOD), e.columns))


_VIDEO = dict(history=24, sigmas=2, rebuffering=0.05, start=5.0, viewers=10, long_history=48, plays=10, suppressed=10, decay=0.998, minutes=2, devices=10)


@query(f"""{_RECURSIVE}, {_NUMBERED}, {_band('b', 'o', 'v', 24)}, {_band('e', 'o', 'x', 24)}, p AS (SELECT *, v / 250 AS y FROM o), {_band('q', 'p', 'y', 48)},
    {_latch('l', 'q', 'o.n >= 24 AND o.y > o.c + 2 * o.sd AND o.d >= 10', 10)}, ls AS (SELECT entity, t, state FROM l JOIN o USING (entity, i)),
    wt AS (SELECT *, v / 20000 AS z, pow(1 / 0.998::DOUBLE, i) AS u FROM o),
    g AS (SELECT *, sum(u * z) OVER a / sum(u) OVER a AS c, sum(u * z * z) OVER a / sum(u) OVER a AS s2 FROM wt WINDOW a AS (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    {_any({
        "hydra": ("n >= 24 AND v > c + 2 * sd", "b"), "hydra_entropy": ("n >= 24 AND (x > c + 2 * sd OR x < c - 2 * sd)", "e"), "mux": ("(v / 20000 > 0.05::DOUBLE OR v / 250 > 5) AND d >= 10", "o"),
        "conviva_ai": ("state", "ls"), "conviva_patent": (_last("i > 24 AND z > c + 2 * sqrt(greatest(0, s2 - c * c)) AND d >= 10", 2) + " >= 2", "g"),
    })}""")
def rules_video(spark, sf):
    e = _evaluations(spark, sf).select("entity", "t", F.col("v").alias("buffering_l1"), (F.col("v") / 100).alias("entropy_bitrate"), (F.col("v") / 20000).alias("rebuffer_ratio"), (F.col("v") / 250).alias("startup_p95"), F.col("d").alias("sessions"), F.col("d").alias("distinct_devices"))
    return U.judged(e, U.video(**_VIDEO))


@query(f"""{_BASE}, o AS (SELECT entity, t, CASE WHEN row_number() OVER (PARTITION BY t ORDER BY v DESC, entity) <= 2 THEN v END AS v FROM r)
    {_any({"aws_waf": ("v > 1000", "o"), "cloud_armor": (_last("v > 1200", 10) + " >= 1", "o"), "fastly": (_last("v > 1300", 2) + " >= 1", "o")})}""")
def rules_rate_limits(spark, sf):
    """Only what is among the top two of an hour has an answer there."""
    top = F.row_number().over(W.partitionBy("t").orderBy(F.desc("v"), "entity")) <= 2
    e = _evaluations(spark, sf).select("entity", "t", F.when(top, F.col("v")).alias("top10_clients")).withColumn("top10_clients_1m", F.col("top10_clients"))
    return U.judged(e, U.rate_limits(1000, 1200, 10, 1300, 2))


def _decided(name: str, of: str, failed: str, checks: int, no: str, yes: str = "false") -> str:
    return f"""SELECT '{name}' AS controller, entity, rollout, CASE WHEN min(CASE WHEN no OR yes THEN i END) IS NULL THEN 'promote' ELSE arg_min(CASE WHEN no THEN 'rollback' ELSE 'promote' END, CASE WHEN no OR yes THEN i END) END AS decision, coalesce(min(CASE WHEN no OR yes THEN i END), max(i)) AS at
        FROM (SELECT *, {no} AS no, {yes} AS yes FROM (SELECT *, sum(f) OVER a AS fails, sum(1 - f) OVER a AS passes, sum(f) OVER (PARTITION BY entity, rollout ORDER BY i ROWS 4 PRECEDING) AS recent, sum(f) OVER (PARTITION BY entity, rollout ORDER BY i ROWS 2 PRECEDING) AS last3
            FROM (SELECT entity, i, i // {checks} AS rollout, coalesce({failed}, false)::INT AS f FROM {of}) WINDOW a AS (PARTITION BY entity, rollout ORDER BY i ROWS UNBOUNDED PRECEDING))) GROUP BY entity, rollout HAVING count(*) = {checks}"""


@query(f"""{_RECURSIVE}, o AS (SELECT entity, v / 2000 AS p99, d / 30 AS p99_stable, v / 1000 AS success_rate, v / 2000 AS p95, row_number() OVER (PARTITION BY entity ORDER BY t) - 1 AS i FROM r),
    fifth AS (SELECT * REPLACE (i // 5 AS i) FROM o WHERE i % 5 = 0), tenth AS (SELECT * REPLACE (i // 10 AS i) FROM o WHERE i % 10 = 0),
    k AS (SELECT DISTINCT entity, -1::BIGINT AS i, []::DOUBLE[] AS kept, false AS failed FROM o UNION ALL
          SELECT entity, i, CASE WHEN failed THEN kept ELSE list_prepend(p95, kept)[1:3] END, failed FROM (SELECT k.entity, n.i, k.kept, n.p95, n.p95 >= 0.6::DOUBLE OR coalesce(n.p95 > 1.1::DOUBLE * list_avg(k.kept), false) AS failed FROM k JOIN tenth n ON n.entity = k.entity AND n.i = k.i + 1)),
    ks AS (SELECT * FROM k WHERE i >= 0)
    {' UNION ALL '.join([
        _decided('three_in_a_row', 'o', 'p99 / p99_stable > 1.1::DOUBLE', 10, 'last3 = 3'), _decided('flagger', 'o', 'p99 > 0.5::DOUBLE OR success_rate < 0.99::DOUBLE', 34, 'fails >= 10', 'passes >= 25'),
        _decided('argo_rollouts', 'fifth', 'success_rate < 0.95::DOUBLE', 10, 'fails > 3'), _decided('cloudwatch', 'o', 'p99 > 0.5::DOUBLE', 10, 'recent >= 4'), _decided('keptn', 'ks', 'failed', 1, 'fails >= 1'),
    ])}""")
def rollout_controllers(spark, sf):
    e = _evaluations(spark, sf).select("entity", "t", (F.col("v") / 2000).alias("p99"), (F.col("d") / 30).alias("p99_stable"), (F.col("v") / 1000).alias("success_rate"), (F.col("v") / 2000).alias("p95"))
    return U.controllers(e)
