"""Views over events: a first run over the earlier half of all evaluations, a second one over all; two queries of one view."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..operators.windows import Grid
from ..plans import panes as P
from ..plans import views as U
from ..sources import chunks as K
from ..sources import records as R
from ..storage import fresh_path
from ..streaming import stateful as T
from . import query, table
from .rules import _BASE, _evaluations
from .windows import _RATE, _S, DAY, HOUR, SERIES, _with, grid, samples

RANGE = 2 * DAY


def _halves(g: Grid) -> tuple[Grid, Grid]:
    """The earlier evaluations of a grid, and all."""
    n = (g.last - g.first) // g.step
    return Grid(g.first, g.first + n // 2 * g.step, g.step), g


def _runs(spark, sf, view):
    s, g = samples(spark, sf), grid(spark, sf, RANGE)
    store = U.Store(spark, fresh_path(spark, "views"))
    early, whole = _halves(g)
    _, first = store.merged(view, s, early, RANGE, retention_ms=1000 * DAY)
    got, second = store.merged(view, s, whole, RANGE, retention_ms=1000 * DAY)
    return got, first, second


@query(_with(RANGE) + " SELECT t, event_type, user_id, count(*) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS largest, arg_max(value, (ts_ms, value)) AS last FROM w GROUP BY ALL")
def view_second_run(spark, sf):
    """The answer of a run that finds half of its panes stored."""
    got, *_ = _runs(spark, sf, U.View(6 * HOUR, tuple(SERIES)))
    return got.select("t", *SERIES, "n", F.round("total", 6).alias("total"), "least", "largest", "last")


@query(_with(RANGE) + " SELECT t, event_type, count(*) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS largest FROM w GROUP BY ALL")
def view_of_view(spark, sf):
    """Day panes by type, made of the stored six-hour panes by series."""
    got, *_ = _runs(spark, sf, U.View(DAY, ("event_type",), source=U.View(6 * HOUR, tuple(SERIES))))
    return got.select("t", "event_type", "n", F.round("total", 6).alias("total"), "least", "largest")


_ENDS = f"""WITH {_S}, b AS (SELECT (min(ts_ms) - 1 + {RANGE}) // {DAY} * {DAY} AS a, (max(ts_ms) + {DAY} - 1) // {DAY} * {DAY} AS z FROM s), h AS (SELECT a - {RANGE} AS low, a + (z - a) // {DAY} // 2 * {DAY} AS mid, z FROM b)"""


@query(_ENDS + f""" SELECT 1 AS run, 1 AS views_refreshed, ((mid - low) // {6 * HOUR})::BIGINT AS panes_built, 0::BIGINT AS panes_reused, (SELECT count(*) FROM s WHERE ts_ms > low AND ts_ms <= mid) AS samples_read FROM h UNION ALL
    SELECT 2, 1, ((z - mid) // {6 * HOUR})::BIGINT, ((mid - low) // {6 * HOUR})::BIGINT, (SELECT count(*) FROM s WHERE ts_ms > mid AND ts_ms <= z) FROM h""")
def view_costs(spark, sf):
    """What each run built and read: the second reads only what came after the first."""
    _, *costs = _runs(spark, sf, U.View(6 * HOUR, tuple(SERIES)))
    rows = [(i + 1, c.views_refreshed, c.panes_built, c.panes_reused, c.samples_read) for i, c in enumerate(costs)]
    return spark.createDataFrame(rows, "run int, views_refreshed int, panes_built long, panes_reused long, samples_read long")


_QUERIES = (U.Over("rate", "rate", 5 * DAY, DAY, tuple(SERIES), by=("event_type",)), U.Over("sum", "sum", 2 * DAY, 2 * DAY, tuple(SERIES), by=()), U.Over("errors", "max", 2 * DAY, DAY, tuple(SERIES), (("event_type", "error"),)))


def _shared(spark, sf):
    s = samples(spark, sf)
    store, plans = U.Store(spark, fresh_path(spark, "views")), U.share(_QUERIES)
    for plan in plans:
        for q in plan.queries:
            yield (plan, q, *U.answer(store, plan, q, s, grid(spark, sf, q.range_ms, q.step)))


@query(_with(5 * DAY) + _RATE.format(r=5 * DAY) + f""", t2 AS (SELECT unnest(range((SELECT (min(ts_ms) - 1 + {2 * DAY}) // {2 * DAY} * {2 * DAY} FROM s), (SELECT (max(ts_ms) + {2 * DAY} - 1) // {2 * DAY} * {2 * DAY} FROM s) + 1, {2 * DAY}))::BIGINT AS t),
    t1 AS (SELECT unnest(range((SELECT (min(ts_ms) - 1 + {2 * DAY}) // {DAY} * {DAY} FROM s), (SELECT (max(ts_ms) + {DAY} - 1) // {DAY} * {DAY} FROM s) + 1, {DAY}))::BIGINT AS t)
    SELECT 'rate' AS query, t, event_type, NULL::BIGINT AS user_id, round(sum(increase / 432000.0::DOUBLE), 9) AS value FROM x GROUP BY t, event_type UNION ALL
    SELECT 'sum', t, NULL, NULL, round(sum(value), 6) FROM s, t2 WHERE ts_ms > t - {2 * DAY} AND ts_ms <= t GROUP BY t UNION ALL
    SELECT 'errors', t, event_type, user_id, max(value) FROM s, t1 WHERE ts_ms > t - {2 * DAY} AND ts_ms <= t AND event_type = 'error' GROUP BY t, event_type, user_id""")
def view_shared_answers(spark, sf):
    """A rate and a sum from the panes of one view, and a filtered query from its own."""
    none = {"event_type": "string", "user_id": "long"}
    out = None
    for _, q, got, _ in _shared(spark, sf):
        lacking = {c: F.lit(None).cast(t) for c, t in none.items() if c not in got.columns}
        got = got.withColumns(lacking).select(F.lit(q.name).alias("query"), "t", "event_type", "user_id", F.round("value", 9 if q.how == "rate" else 6).alias("value"))
        out = got if out is None else out.union(got)
    return out


@query(f"""WITH {_S}, g AS (SELECT min(ts_ms) AS lo, max(ts_ms) AS hi FROM s),
    q AS (SELECT * FROM (VALUES ('rate', {5 * DAY}, {DAY}, {2 * DAY}, 2), ('sum', {2 * DAY}, {2 * DAY}, {2 * DAY}, 2), ('errors', {2 * DAY}, {DAY}, {DAY}, 1)) v(query, range_ms, step, together, shared_by)),
    e AS (SELECT *, (lo - 1 + range_ms) // step * step - range_ms AS low, (hi + step - 1) // step * step AS high FROM q, g),
    r AS (SELECT low AS a, high AS z FROM e WHERE query = 'rate')
    SELECT query, {DAY}::BIGINT AS width, (range_ms // {DAY})::BIGINT AS panes, together::BIGINT AS together, shared_by::BIGINT AS shared_by,
        CASE query WHEN 'sum' THEN (SELECT count(*) FROM s, r WHERE ts_ms > low AND ts_ms <= high AND (ts_ms <= a OR ts_ms > z)) WHEN 'errors' THEN (SELECT count(*) FROM s WHERE event_type = 'error' AND ts_ms > low AND ts_ms <= high) ELSE (SELECT count(*) FROM s WHERE ts_ms > low AND ts_ms <= high) END AS samples_read
    FROM e""")
def view_shared_report(spark, sf):
    """Which queries share a view, and what each still had to read: the second of two reads next to nothing."""
    found = list(_shared(spark, sf))
    plans = list({id(p): p for p, *_ in found}.values())
    read = spark.createDataFrame([(q.name, c.samples_read) for _, q, _, c in found], "query string, samples_read long")
    return U.report(spark, plans).join(read, "query").select("query", "width", "panes", "together", "shared_by", "samples_read")


LATE = 2 * DAY


@query(f"""WITH {_S}, p AS (SELECT ((ts_ms - 1) // {DAY} + 1) * {DAY} AS window_end, event_type, user_id, value, ts_ms FROM s)
    SELECT window_end, event_type, user_id, count(*) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS largest, arg_min(value, (ts_ms, value)) AS first, arg_max(value, (ts_ms, value)) AS last
    FROM p WHERE window_end + {LATE} <= (SELECT max(ts_ms) FROM s) GROUP BY ALL""")
def stream_complete_panes(spark, sf):
    """Events as a stream: the panes that a stateful operator has given out as complete by the end, two days after theirs."""
    path = fresh_path(spark, "stream")
    source = table(spark, sf, "events")
    raw = spark.readStream.schema(source.schema).parquet(_folder(spark, sf))
    s = raw.select("event_type", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "value")
    T.run_to_end(T.keep_complete(s, f"{path}/out", f"{path}/checkpoint", DAY, SERIES, LATE, strict=False))
    return T.complete(spark, f"{path}/out").select("window_end", *SERIES, "n", F.round("total", 6).alias("total"), "least", "largest", "first", "last")


def _folder(spark, sf) -> str:
    """A folder that holds the events' files and no others: a stream reads folders, and events may be one file beside others."""
    path = fresh_path(spark, "events")
    table(spark, sf, "events").write.parquet(path)
    return path


def _sample_schema():
    return StructType([StructField("event_type", StringType()), StructField("user_id", LongType()), StructField("ts_ms", LongType()), StructField("value", DoubleType())])


@query(f"WITH {_S}, p AS (SELECT ((ts_ms - 1) // {DAY} + 1) * {DAY} AS window_end, event_type, value FROM s) SELECT window_end, event_type, count(*) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS largest, 0::BIGINT AS malformed FROM p GROUP BY ALL")
def chunked_panes(spark, sf):
    """Events as JSON lines, cut by days and replayed in two goes, the first of which stops after five chunks; panes of all chunks."""
    path, schema, g = fresh_path(spark, "chunks"), _sample_schema(), grid(spark, sf, DAY)
    K.write_lines(samples(spark, sf), f"{path}/lines")
    s = K.read_lines(spark, f"{path}/lines", schema)
    ends = list(range(g.first, g.last + 1, g.step))
    K.cut(s, ends, f"{path}/cut")

    def refresh(part, i, end):
        P.build(part, DAY, ("event_type",)).write.mode("overwrite").parquet(f"{path}/panes/chunk={i}")

    K.replay(spark, f"{path}/cut", schema, ends[:5], f"{path}/done", refresh)
    K.replay(spark, f"{path}/cut", schema, ends, f"{path}/done", refresh)
    bad = K.malformed(spark, f"{path}/lines", schema).agg(F.count(F.lit(1)).alias("malformed"))
    panes = spark.read.parquet(f"{path}/panes").select("window_end", "event_type", "n", F.round("total", 6).alias("total"), "least", "largest")
    return panes.crossJoin(F.broadcast(bad))  # one row


_ALERTS = f"""{_BASE}, x AS (SELECT t, entity, 'exact' AS arm, v FROM r UNION ALL SELECT t, entity, 'approx', v FROM a)
    SELECT 'app_state' AS kind, t AS time, entity, arm, 'state' AS metric, NULL::DOUBLE AS value_num, CASE WHEN v > 900 THEN 'active' ELSE 'idle' END AS value_str FROM x UNION ALL
    SELECT 'fidelity_summary', max(t), NULL, NULL, 'active', count(*) FILTER (v > 900), NULL FROM x"""


@query(_ALERTS)
def run_records(spark, sf):
    """A rule's states of both arms as records of one run, which was written wrongly before and is written again; with its agreement as a summary."""
    root, rows = fresh_path(spark, "records"), None
    for arm, drawn in (("exact", False), ("approx", True)):
        state = _evaluations(spark, sf, drawn).select("entity", "t", F.when(F.col("v") > 900, "active").otherwise("idle").alias("state"))
        one = state.select(*R.record(F.col("t"), "app_state", "run-1", {"entity": F.col("entity"), "arm": F.lit(arm)}, "state", F.col("state"), "state", text=True))
        rows = one if rows is None else rows.union(one)
    R.write_run(rows.limit(3), root, "run-1", "alerts")
    n = rows.groupBy().agg(F.max("time").alias("time"), F.count_if(F.col("value_str") == "active").alias("n"))
    R.write_run(rows.union(n.select(*R.record(F.col("time"), "fidelity_summary", "run-1", {}, "active", F.col("n"), "evaluations"))), root, "run-1", "alerts")
    read = R.read_runs(spark, root, ["run-1"])
    return read.select("kind", "time", F.col("labels")["entity"].alias("entity"), F.col("labels")["arm"].alias("arm"), "metric", "value_num", "value_str")
