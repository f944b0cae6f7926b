"""Decision rules over hourly evaluations of events: an entity is an event type.

v is the sum of values over six hours, d the number of users; the approximate arm
is the sum over the fifth of events that a hash draws, scaled up.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import P
from ..operators import published as U
from ..operators import rules as R
from ..operators import stream_sketches as T
from ..operators import windows as V
from . import query, table
from .sketches import cw
from .windows import _S, HOUR, grid, times_sql

_DRAWN = f"{cw('event_id', 0, 70)} < {int(0.2 * P)}"
_BASE = f"""WITH {_S.replace('event_type, user_id', 'event_type, user_id, event_id')},
    {times_sql(6 * HOUR, HOUR)}, w AS (SELECT t, s.* FROM s, times WHERE ts_ms > t - {6 * HOUR} AND ts_ms <= t),
    r AS (SELECT event_type AS entity, t, round(sum(value), 6) AS v, count(DISTINCT user_id)::DOUBLE AS d FROM w GROUP BY ALL),
    a AS (SELECT event_type AS entity, t, round(sum(value) * 5, 6) AS v, count(DISTINCT user_id)::DOUBLE AS d FROM w WHERE {_DRAWN} GROUP BY ALL)"""


def _evaluations(spark, sf, drawn=False):
    s = table(spark, sf, "events").select(F.col("event_type").alias("entity"), "user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "value")
    s = T.sampled(s, F.col("event_id"), 0.2) if drawn else s
    rows = V.windowed(s, grid(spark, sf, 6 * HOUR, HOUR), 6 * HOUR).groupBy("entity", "t")
    return rows.agg(F.round(F.sum("value") * (5 if drawn else 1), 6).alias("v"), F.countDistinct("user_id").cast("double").alias("d"))


_BAND = "avg({v}) OVER p AS c, stddev_pop({v}) OVER p AS sd, count({v}) OVER p AS n"


def _band_sql(test: str, size: int = 24, v: str = "v", rel: str = "r") -> str:
    return f"{_BASE} SELECT entity, t, n >= {size} AND ({test}) AS state FROM (SELECT *, {_BAND.format(v=v)} FROM {rel} WINDOW p AS (PARTITION BY entity ORDER BY t ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING))"


def _states(df, flag):
    return df.withColumn("state", flag).select("entity", "t", "state")


@query(f"{_BASE} SELECT entity, t, v > 900 AS state FROM r")
def rule_threshold(spark, sf):
    return _states(_evaluations(spark, sf), R.above("v", 900))


@query(_band_sql("v > c + 2 * sd"))
def rule_band_sigma(spark, sf):
    return _states(_evaluations(spark, sf), R.above_band("v", 24, 2))


@query(_band_sql("v > c + 2 * sd OR v < c - 2 * sd"))
def rule_outside_band(spark, sf):
    return _states(_evaluations(spark, sf), R.outside_band("v", 24, 2))


@query(_band_sql("v > 1.3::DOUBLE * c"))
def rule_mean_times(spark, sf):
    return _states(_evaluations(spark, sf), R.above_mean_times("v", 24, 1.3))


def _hold_sql(size: int, least: int) -> str:
    return f"{_BASE} SELECT entity, t, sum((v > 900)::INT) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) >= {least} AS state FROM r"


@query(_hold_sql(3, 3))
def rule_for_consecutive(spark, sf):
    df = _evaluations(spark, sf).withColumn("hit", R.above("v", 900))
    return _states(df, R.for_consecutive("hit", 3))


@query(_hold_sql(6, 3))
def rule_x_of_y(spark, sf):
    df = _evaluations(spark, sf).withColumn("hit", R.above("v", 900))
    return _states(df, R.x_of_last_y("hit", 3, 6))


@query(f"{_BASE} SELECT entity, t, sum((v >= 900)::INT) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 3 AS state FROM r")
def rule_ec2(spark, sf):
    df = _evaluations(spark, sf).withColumn("hit", R.at_least("v", 900))
    return _states(df, R.for_consecutive("hit", 3))


@query(f"{_BASE} SELECT entity, t, d > 14 / 1.15::DOUBLE OR v < 600 / 1.15::DOUBLE OR v > 1300 / 1.15::DOUBLE AS state FROM r")
def rule_vpa(spark, sf):
    return _states(_evaluations(spark, sf), R.above("d", 14 / 1.15) | R.below("v", 600 / 1.15) | R.above("v", 1300 / 1.15))


_ARMS = f"{_BASE}, x AS (SELECT entity, t, coalesce(r.v > 900, false) AS e, coalesce(a.v > 900, false) AS q, row_number() OVER (PARTITION BY entity ORDER BY t) AS i FROM (SELECT * FROM (SELECT DISTINCT entity FROM r), (SELECT DISTINCT t FROM r)) LEFT JOIN r USING (entity, t) LEFT JOIN a USING (entity, t))"


def _arms(spark, sf):
    state = lambda drawn: _states(_evaluations(spark, sf, drawn), R.above("v", 900))
    return R.spine(state(False), state(True))


@query(f"""{_ARMS} SELECT count(*) FILTER (e AND q) AS true_positive, count(*) FILTER (NOT e AND q) AS false_positive, count(*) FILTER (e AND NOT q) AS false_negative, count(*) FILTER (NOT e AND NOT q) AS true_negative,
    round(count(*) FILTER (e = q) / count(*)::DOUBLE, 9) AS agreement, round(count(*) FILTER (e AND q) / (count(*) FILTER (e OR q))::DOUBLE, 9) AS active_agreement, count(DISTINCT entity) AS entities FROM x""")
def alert_confusion(spark, sf):
    return R.confusion(_arms(spark, sf)).withColumn("agreement", F.round("agreement", 9)).withColumn("active_agreement", F.round("active_agreement", 9))


@query(f"""{_ARMS}, y AS (SELECT *, i - row_number() OVER (PARTITION BY entity, e ORDER BY i) AS g FROM x), z AS (SELECT *, min(CASE WHEN q THEN i END) OVER (PARTITION BY entity, g) AS o FROM y WHERE e),
    k AS (SELECT *, NOT q AND i > o AND coalesce(lag(q) OVER (PARTITION BY entity, g ORDER BY i), true) AS gap FROM z)
    SELECT entity, min(t) AS start, max(t) AS "end", count(*) AS evaluations, coalesce(min(o) - min(i), -1) AS onset_delay, count(*) FILTER (gap) AS gaps FROM k GROUP BY entity, g""")
def alert_episodes(spark, sf):
    return R.episodes(_arms(spark, sf)).withColumn("onset_delay", F.coalesce("onset_delay", F.lit(-1)))


@query(f"""{_ARMS}, y AS (SELECT *, q AND NOT e AS f, i - row_number() OVER (PARTITION BY entity, (q AND NOT e) ORDER BY i) AS g FROM x)
    SELECT entity, min(t) AS start, max(t) AS "end", count(*) AS evaluations FROM y WHERE f GROUP BY entity, g""")
def alert_false_spans(spark, sf):
    return R.false_spans(_arms(spark, sf))


@query(f"""{_BASE}, e AS (SELECT t, entity FROM r QUALIFY row_number() OVER (PARTITION BY t ORDER BY v DESC, entity) <= 2), q AS (SELECT t, entity FROM a QUALIFY row_number() OVER (PARTITION BY t ORDER BY v DESC, entity) <= 2),
    b AS (SELECT coalesce(e.t, q.t) AS t, e.t IS NOT NULL AS x, q.t IS NOT NULL AS y FROM e FULL JOIN q ON e.t = q.t AND e.entity = q.entity)
    SELECT t, count(*) FILTER (x AND y) AS overlap, count(*) FILTER (x AND NOT y) AS exact_only, count(*) FILTER (y AND NOT x) AS approx_only, bool_and(x AND y) AS identical FROM b GROUP BY t""")
def topk_set_fidelity(spark, sf):
    top = lambda drawn: V.topk(_evaluations(spark, sf, drawn).select("entity", "t", F.col("v").alias("value")), 2, ["entity"])
    return R.top_set_fidelity(top(False), top(True))


_SCALE = "CASE WHEN v > 1100 OR d > 15 THEN 'up' WHEN v < 700 AND d < 12 THEN 'down' ELSE 'none' END"


def _scaled(spark, sf, drawn=False):
    df = _evaluations(spark, sf, drawn).withColumn("decision", R.scale("v", "d", 1100, 15, 700, 12))
    return df.withColumn("action", R.actions("decision")).select("entity", "t", "decision", "action")


@query(f"{_BASE}, x AS (SELECT entity, t, {_SCALE} AS decision FROM r) SELECT *, CASE WHEN decision <> 'none' AND lag(decision) OVER (PARTITION BY entity ORDER BY t) <> decision THEN decision ELSE 'none' END AS action FROM x")
def decision_autoscale(spark, sf):
    return _scaled(spark, sf)


_MATCHED = _BASE.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
    x AS (SELECT 0 AS arm, entity, t, {_SCALE} AS d FROM r UNION ALL SELECT 1, entity, t, {_SCALE} FROM a),
    y AS (SELECT arm, entity, t, CASE WHEN d <> 'none' AND lag(d) OVER (PARTITION BY arm, entity ORDER BY t) <> d THEN d ELSE 'none' END AS act FROM x),
    z AS (SELECT e.entity, e.act AS e, coalesce(q.act, 'none') AS q, (row_number() OVER (PARTITION BY e.entity ORDER BY e.t) - 1)::INT AS i FROM (SELECT * FROM y WHERE arm = 0) e LEFT JOIN (SELECT * FROM y WHERE arm = 1) q USING (entity, t)),
    c AS (SELECT entity, a.e AS act, a.i AS i, b.i AS j, row_number() OVER (PARTITION BY entity ORDER BY abs(a.i - b.i), b.i, a.i) AS k FROM z a JOIN z b USING (entity) WHERE a.e <> 'none' AND a.e = b.q AND abs(a.i - b.i) <= 2),
    g AS (SELECT DISTINCT entity, 0::BIGINT AS k, []::INT[] AS ei, []::INT[] AS qj FROM c UNION ALL
          SELECT g.entity, c.k, CASE WHEN list_contains(ei, i) OR list_contains(qj, j) THEN ei ELSE list_append(ei, i) END, CASE WHEN list_contains(ei, i) OR list_contains(qj, j) THEN qj ELSE list_append(qj, j) END FROM g JOIN c ON g.entity = c.entity AND c.k = g.k + 1),
    m AS (SELECT entity, unnest(ei) AS i, unnest(qj) AS j FROM g WHERE k = (SELECT max(k) FROM c WHERE c.entity = g.entity))
    SELECT z.entity, e AS action, z.i AS exact_at, m.j AS approx_at FROM z LEFT JOIN m ON m.entity = z.entity AND m.i = z.i WHERE e <> 'none'
    UNION ALL SELECT z.entity, q, NULL, z.i FROM z LEFT JOIN m ON m.entity = z.entity AND m.j = z.i WHERE q <> 'none' AND m.j IS NULL"""


@query(_MATCHED)
def decision_matched_actions(spark, sf):
    e, a = (_scaled(spark, sf, drawn).select("entity", "t", F.col("action").alias(n)) for drawn, n in ((False, "exact"), (True, "approx")))
    return R.matched_actions(e.join(a, ["entity", "t"], "left").fillna("none"))


@query(f"SELECT action, count(*) FILTER (exact_at IS NOT NULL AND approx_at IS NOT NULL) AS true_positive, count(*) FILTER (approx_at IS NULL) AS false_negative, count(*) FILTER (exact_at IS NULL) AS false_positive, round(avg(approx_at - exact_at), 9) AS mean_delay, count(*) FILTER (approx_at < exact_at) AS early, count(*) FILTER (approx_at > exact_at) AS late FROM ({_MATCHED}) GROUP BY action")
def decision_action_summary(spark, sf):
    return R.action_summary(decision_matched_actions(spark, sf)).withColumn("mean_delay", F.round("mean_delay", 9))


@query(f"{_BASE}, x AS (SELECT entity, t, {_SCALE} AS e FROM r), y AS (SELECT entity, t, {_SCALE} AS q FROM a) SELECT coalesce(e, 'none') AS exact, coalesce(q, 'none') AS approx, count(*) AS n FROM x FULL JOIN y USING (entity, t) GROUP BY ALL")
def decision_pairs(spark, sf):
    return R.decision_pairs(_scaled(spark, sf), _scaled(spark, sf, True))


_ROLL = _BASE + """, f AS (SELECT entity, t, v > 900 AS f, row_number() OVER (PARTITION BY entity ORDER BY t) - 1 AS i FROM r), g AS (SELECT *, i // 10 AS roll FROM f),
    h AS (SELECT *, sum(f::INT) OVER w AS fails, sum(1 - f::INT) OVER w AS passes, i - coalesce(max(CASE WHEN NOT f THEN i END) OVER w, roll * 10 - 1) AS streak FROM g WINDOW w AS (PARTITION BY entity, roll ORDER BY i ROWS UNBOUNDED PRECEDING)),
    k AS (SELECT entity, roll, min(CASE WHEN {hit} THEN i END) AS hit, max(i) AS l FROM h GROUP BY ALL HAVING count(*) = 10)
    SELECT entity, roll AS rollout, CASE WHEN hit IS NULL THEN 'promote' ELSE 'rollback' END AS decision, coalesce(hit, l) AS at FROM k"""


def _rollout(spark, sf, hit):
    return U.decided(_evaluations(spark, sf).withColumn("failed", R.above("v", 900)), "failed", 10, hit)


@query(_ROLL.format(hit="streak >= 3"))
def rollout_streak(spark, sf):
    return _rollout(spark, sf, lambda fails, row, passes, recent: row >= 3)


@query(_ROLL.format(hit="fails > 3"))
def rollout_failure_limit(spark, sf):
    return _rollout(spark, sf, lambda fails, row, passes, recent: fails > 3)


@query(f"{_BASE} SELECT entity, t, CASE WHEN v * 0.95::DOUBLE > 900 THEN true WHEN v * 1.05::DOUBLE <= 900 THEN false END AS check_, coalesce(CASE WHEN v * 0.95::DOUBLE > 900 THEN true WHEN v * 1.05::DOUBLE <= 900 THEN false END, false) AS bound FROM a")
def rule_interval_bound(spark, sf):
    """Answers that are off by 5% at most: checks that the interval leaves open, and what they settle to."""
    c = R.interval_gt(F.col("v") * 0.95, F.col("v") * 1.05, F.lit(900.0))
    return _evaluations(spark, sf, True).select("entity", "t", c.alias("check_"), R.settle(c, F.lit(None), "bound").alias("bound"))


@query(_BASE.replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t) AS i FROM r),
    b AS (SELECT entity, avg(v) AS m, stddev_pop(v) AS sd FROM o WHERE i <= 50 GROUP BY entity HAVING count(v) = 50),
    c AS (SELECT entity, 50::BIGINT AS i, 0.0::DOUBLE AS s FROM b UNION ALL SELECT entity, o.i, least(10 * sd, greatest(0, s + v - m - 0.5::DOUBLE * sd)) FROM c JOIN b USING (entity) JOIN o USING (entity) WHERE o.i = c.i + 1)
    SELECT entity, t, coalesce(o.i > 50 AND s > 5 * sd, false) AS state FROM o LEFT JOIN c USING (entity, i) LEFT JOIN b USING (entity)""")
def rule_cusum(spark, sf):
    return R.cusum(_evaluations(spark, sf), "v", "state", 50, 0.5, 5).select("entity", "t", "state")


@query(_BASE + """, o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t) AS i FROM r), e AS (SELECT *, pow(1 / 0.998::DOUBLE, i) AS w FROM o),
    m AS (SELECT *, sum(w) OVER p AS s0, sum(w * v) OVER p / sum(w) OVER p AS c, sum(w * v * v) OVER p / sum(w) OVER p AS q FROM e WINDOW p AS (PARTITION BY entity ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT entity, t, coalesce(i > 30 AND v > c + 2 * sqrt(greatest(0, q - c * c)), false) AS state FROM m""")
def rule_decayed_band(spark, sf):
    return R.above_decayed_band(_evaluations(spark, sf), "v", "state", 0.998, 2, 30).select("entity", "t", "state")


@query(f"{_BASE} SELECT entity, t, max((v > 1100)::INT) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) = 1 AS state FROM r")
def rule_latch(spark, sf):
    return R.latch(_evaluations(spark, sf).withColumn("hit", R.above("v", 1100)), "hit", "state", 10).select("entity", "t", "state")
