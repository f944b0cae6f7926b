"""Order-dependent and built-in sketches, and scores of sketches against exact answers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.hashing import P, integer_key
from ..operators import exact as X
from ..operators import scoring as C
from ..operators import sketches as S
from ..operators import stream_sketches as T
from . import query, table
from .sketches import _GRID, _KEYS, COLS, LABELS, ROWS, _asked, _by_labels, _fanned, _gridded, cells_sql, classic_sql, cms_estimate, cms_topk, cw, dd_quantile, estimate_sql, hll_estimate, hydra_hll, leading, registers_sql, rows_of, sign, univmon_sql


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


_ROW = "(l_orderkey * 8 + l_linenumber)"


def _row():
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


@query(f"""
    WITH h AS (SELECT o_orderkey, {cw('o_custkey', 0, 20)} % 512 AS b, {leading(cw('o_custkey', 1, 20))} AS rho FROM orders),
    o AS (SELECT *, coalesce(max(rho) OVER (PARTITION BY b ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS old FROM h),
    r AS (SELECT *, coalesce(sum(pow(2.0::DOUBLE, -old) - pow(2.0::DOUBLE, -rho)) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lost FROM o WHERE rho > old)
    SELECT round(sum(512 / (512 - lost)), 6) AS estimate FROM r
""")
def hll_hip(spark, sf):
    return T.hll_hip(table(spark, sf, "orders"), integer_key(F.col("o_custkey")), ["o_orderkey"], 9).withColumn("estimate", F.round("estimate", 6))


def _nitro_sql(signed: bool) -> str:
    s = sign("l_partkey", "r") if signed else "1"
    return f"""WITH m AS (SELECT r, {cw('l_partkey', 'r')} % {COLS} AS c, sum({s}) / 0.25::DOUBLE AS n FROM lineitem, {rows_of(ROWS)} WHERE {cw(_ROW, 'r', 70)} < {int(0.25 * P)} GROUP BY 1, 2),
        {_KEYS}, q AS (SELECT l_partkey, r, {cw('l_partkey', 'r')} % {COLS} AS c, {s} AS s FROM k, {rows_of(ROWS)})
        SELECT l_partkey, list_sort(list(coalesce(n, 0) * s + 0.0::DOUBLE))[{ROWS // 2 + 1}] AS estimate FROM q LEFT JOIN m USING (r, c) GROUP BY 1"""


def _nitro(spark, sf, signed):
    df, key = _lines(spark, sf), integer_key(F.col("l_partkey"))
    return T.nitro_estimate(T.nitro(df, _row(), key, 0.25, ROWS, COLS, signed), df.select("l_partkey").distinct(), key, ROWS, COLS, signed)


@query(_nitro_sql(False))
def nitro_cms(spark, sf):
    return _nitro(spark, sf, False)


@query(_nitro_sql(True))
def nitro_cs(spark, sf):
    return _nitro(spark, sf, True)


_SAMPLE = f"(SELECT * FROM lineitem WHERE {cw(_ROW, 0, 70)} < {int(0.1 * P)})"


@query(" UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, round(quantile_cont(l_extendedprice, {q}), 6) AS value FROM {_SAMPLE}" for q in (0.1, 0.5, 0.9)))
def uniform_sample_quantile(spark, sf):
    return T.uniform_quantiles(_lines(spark, sf), _row(), "l_extendedprice", 0.1, [0.1, 0.5, 0.9]).withColumn("value", F.round("value", 6))


_Q = dict(layers=16, rows=3, cols=256, heap=64)
_SAMPLES = 256
_UQ = univmon_sql("lineitem", "l_partkey", "1", **_Q)


def _univmon_q(spark, sf):
    return S.univmon_q(_lines(spark, sf).select("l_partkey"), "l_partkey", **_Q, samples=_SAMPLES)


@query(f"WITH {_UQ} SELECT cardinality AS estimate FROM u")
def univmon_q_cardinality(spark, sf):
    return S.univmon_q_cardinality(_univmon_q(spark, sf)[1], _Q["layers"])


@query(f"WITH {_UQ} SELECT k AS l_partkey, estimate FROM u_e WHERE layer = deep")
def univmon_q_frequency(spark, sf):
    probes = _lines(spark, sf).select("l_partkey").distinct()
    return S.univmon_q_frequency(_univmon_q(spark, sf)[0], probes, "l_partkey", _Q["layers"], _Q["rows"], _Q["cols"])


@query(f"WITH {_UQ} SELECT k AS l_partkey, arg_max(estimate, layer) AS estimate FROM u_h GROUP BY k ORDER BY estimate DESC, l_partkey LIMIT 32")
def univmon_q_topk(spark, sf):
    return S.univmon_q_topk(_univmon_q(spark, sf)[1], "l_partkey", 32)


_UQ_RANKED = f"""{_UQ}, q_s AS (SELECT layer, k, estimate, row_number() OVER (PARTITION BY layer ORDER BY {cw('k', 0, 95)}, k) AS i FROM u_e),
    q_w AS (SELECT min(layer) AS shallowest FROM (SELECT layer, count(*) AS n FROM q_s WHERE i <= {_SAMPLES + 1} GROUP BY layer) WHERE n <= {_SAMPLES} OR layer = {_Q['layers'] - 1}),
    q_h AS (SELECT k, estimate::DOUBLE AS n FROM u_h WHERE layer = 0),
    q_k AS (SELECT * FROM q_h UNION ALL SELECT k, estimate * pow(2.0::DOUBLE, layer) FROM q_s, q_w WHERE layer = shallowest AND i <= {_SAMPLES + 1} AND estimate > 0 AND k NOT IN (SELECT k FROM q_h)),
    q_r AS (SELECT k, sum(n) OVER (ORDER BY k) AS upto, sum(n) OVER () AS a FROM q_k)"""


@query(f"WITH {_UQ_RANKED} SELECT q, min(k) AS value FROM q_r, (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS q) WHERE upto >= greatest(ceil(q * a), 1) GROUP BY q")
def univmon_q_quantile(spark, sf):
    """Quantiles of the stream of part keys, from the first heap and the shallowest layer that is held whole."""
    return S.univmon_q_quantiles(_univmon_q(spark, sf)[1], _Q["layers"], _SAMPLES, [0.1, 0.5, 0.9])


@query()
def kll_quantile(spark, sf):
    shards = T.kll(_lines(spark, sf).withColumn("shard", F.col("l_orderkey") % 4), "l_extendedprice", 200, ["shard"])
    return T.kll_quantiles(T.kll_merge(shards), [0.01, 0.25, 0.5, 0.75, 0.99])


@query()
def kll_cdf(spark, sf):
    return T.kll_ranks(T.kll(_lines(spark, sf), "l_quantity", 400), [5, 10, 20, 30, 40])


@query()
def hydra_kll(spark, sf):
    """Medians of order quantities by label subset, from one KLL sketch for each grid cell."""
    states = T.kll(_by_labels(spark, sf).withColumn("w", F.col("w").cast("double")), "w", 200, LABELS)
    q = T.kll_quantiles(T.kll_merge(_gridded(states), ["gr", "gc"]), [0.5], ["gr", "gc"])
    return _asked(spark, sf).join(q, ["gr", "gc"]).groupBy("grp").agg(F.sort_array(F.collect_list("value"))[1].alias("value"))


@query()
def hydra_kll_cdf(spark, sf):
    states = T.kll(_by_labels(spark, sf).withColumn("w", F.col("w").cast("double")), "w", 200, LABELS)
    q = T.kll_ranks(T.kll_merge(_gridded(states), ["gr", "gc"]), [10, 25, 40], ["gr", "gc"])
    return _asked(spark, sf).join(q, ["gr", "gc"]).groupBy("grp", "x").agg(F.sort_array(F.collect_list("share"))[1].alias("share"))


@query()
def theta_distinct(spark, sf):
    return table(spark, sf, "orders").agg(F.expr("theta_sketch_estimate(theta_sketch_agg(o_custkey))").alias("estimate"))


@query()
def builtin_hll(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.hll_sketch_estimate(F.hll_sketch_agg("o_custkey", 12)).alias("estimate"))


@query()
def approx_topk(spark, sf):
    return _lines(spark, sf).agg(F.expr("approx_top_k(l_suppkey, 20, 1000)").alias("t")).select(F.explode("t").alias("x")).select("x.item", "x.count")


@query()
def space_saving(spark, sf):
    return T.space_saving(_lines(spark, sf), "l_suppkey", 256)


@query()
def space_saving_cms(spark, sf):
    """Space Saving's candidates, counted by a Count-Min matrix."""
    df = _lines(spark, sf).select("l_suppkey")
    key = integer_key(F.col("l_suppkey"))
    return S.top(S.estimate(S.matrix(df, key, ROWS, COLS), T.space_saving(df, "l_suppkey", 256).select(F.col("key").alias("l_suppkey")), key, ROWS, COLS), "l_suppkey", 32)


@query()
def space_saving_cs(spark, sf):
    df = _lines(spark, sf).select("l_suppkey")
    key = integer_key(F.col("l_suppkey"))
    return S.top(S.estimate(S.matrix(df, key, ROWS, COLS, True), T.space_saving(df, "l_suppkey", 256).select(F.col("key").alias("l_suppkey")), key, ROWS, COLS, True), "l_suppkey", 32)


@query()
def elastic(spark, sf):
    return T.elastic(_lines(spark, sf), "l_suppkey", 512, ROWS, COLS)


@query()
def coco(spark, sf):
    return T.coco(_lines(spark, sf), "l_suppkey", 2, 512)


# -- scores --------------------------------------------------------------------------------------------------------


@query(f"""
    WITH {registers_sql('g', 'orders', 'o_custkey', 9)}, e AS (SELECT round(estimate, 6) AS estimate FROM ({classic_sql('g', 9)})), t AS (SELECT count(DISTINCT o_custkey)::DOUBLE AS truth FROM orders)
    SELECT truth, estimate, round(abs(estimate - truth), 6) AS absolute_error, round(abs(estimate - truth) / truth, 9) AS relative_error FROM t, e
""")
def score_cardinality(spark, sf):
    return C.scalar(X.cardinality(table(spark, sf, "orders"), "o_custkey"), "distinct_values", hll_estimate(spark, sf), "estimate").withColumn("absolute_error", F.round("absolute_error", 6)).withColumn("relative_error", F.round("relative_error", 9))


_PAIRS = f"{cells_sql('m', 'lineitem', 'l_partkey', ROWS, COLS)}, {_KEYS}, {estimate_sql('e', 'm', 'k', 'l_partkey', ROWS, COLS)}, f AS (SELECT l_partkey, count(*) AS truth FROM lineitem GROUP BY 1), p AS (SELECT l_partkey, truth, estimate, abs(estimate - truth) AS d, row_number() OVER (ORDER BY truth DESC, l_partkey) AS i FROM f JOIN e USING (l_partkey))"


def _pairs(spark, sf):
    truth = X.frequency(_lines(spark, sf), "l_partkey").toDF("l_partkey", "truth")
    return C.aligned(truth, cms_estimate(spark, sf), ["l_partkey"])


@query(f"""
    WITH {_PAIRS}
    SELECT 'top' || k AS population, round(avg(d / truth), 9) AS are, round(avg(d), 9) AS aae, count(*) AS probes, NULL::DOUBLE AS l1, NULL::DOUBLE AS l2 FROM p, (SELECT unnest([1, 10, 100, 1000]) AS k) WHERE i <= k GROUP BY k HAVING count(*) = k
    UNION ALL SELECT 'all', round(avg(d / truth), 9), round(avg(d), 9), count(*), sum(d)::DOUBLE, round(sqrt(sum(d::DOUBLE * d)), 6) FROM p
""")
def score_frequency_curve(spark, sf):
    c = C.curve(_pairs(spark, sf), ["l_partkey"])
    return c.withColumn("are", F.round("are", 9)).withColumn("aae", F.round("aae", 9)).withColumn("l2", F.round("l2", 6))


@query(f"WITH {_PAIRS} SELECT round(list_sort(list(d / truth::DOUBLE))[round((count(*) - 1) * 0.99::DOUBLE)::INT + 1], 9) AS relative_error FROM p")
def score_error_p99(spark, sf):
    return C.error_percentile(_pairs(spark, sf), 0.99).withColumn("relative_error", F.round("relative_error", 9))


@query(f"""
    WITH {_PAIRS}, t AS (SELECT l_partkey, truth FROM p WHERE i <= 32),
    a AS (SELECT l_partkey, estimate FROM e ORDER BY estimate DESC, l_partkey LIMIT 32), b AS (SELECT truth, estimate FROM t FULL JOIN a USING (l_partkey))
    SELECT count(*) FILTER (truth IS NOT NULL AND estimate IS NOT NULL) / count(estimate)::DOUBLE AS precision_at_k, count(*) FILTER (truth IS NOT NULL AND estimate IS NOT NULL) / count(truth)::DOUBLE AS recall_at_k,
           count(truth) AS true_count, count(estimate) AS est_count, coalesce(max(abs(estimate - truth)), 0)::DOUBLE AS max_count_err, round(coalesce(avg(abs(estimate - truth)), 0), 9) AS mean_count_err FROM b
""")
def score_topk(spark, sf):
    truth = X.ranked(X.frequency(_lines(spark, sf), "l_partkey"), 32).select(F.col("key").alias("l_partkey"), F.col("n").alias("truth"))
    return C.top_sets(truth, cms_topk(spark, sf), "l_partkey").withColumn("mean_count_err", F.round("mean_count_err", 9))


@query(f"""
    WITH b AS (SELECT ceil(ln(l_extendedprice) / {math.log(1.02 / 0.98)!r}::DOUBLE)::BIGINT AS i, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT i, n, sum(n) OVER (ORDER BY i) AS u, sum(n) OVER () AS a FROM b),
    x AS (SELECT q, round(2 * pow({1.02 / 0.98!r}::DOUBLE, i) / {1.02 / 0.98 + 1!r}::DOUBLE, 6) AS value FROM r, (SELECT unnest([0.01, 0.5, 0.9, 0.99])::DOUBLE AS q) WHERE ceil(q * a) > u - n AND ceil(q * a) <= u),
    y AS (SELECT q, value, count(*) FILTER (l_extendedprice < value) AS lo, count(*) FILTER (l_extendedprice <= value) AS hi, count(*) AS n FROM x, lineitem GROUP BY ALL)
    SELECT q, value, round(CASE WHEN q * n < lo THEN lo - q * n WHEN q * n > hi THEN q * n - hi ELSE 0 END / n, 9) AS rank_error FROM y
""")
def score_rank_error(spark, sf):
    return C.rank_errors(_lines(spark, sf), "l_extendedprice", dd_quantile(spark, sf)).withColumn("rank_error", F.round("rank_error", 9))


@query(f"""
    WITH s AS (SELECT l_returnflag, x, avg(CASE WHEN l_quantity <= x THEN 1.0::DOUBLE ELSE 0 END) AS e FROM {_SAMPLE}, (SELECT unnest([10, 25, 40])::DOUBLE AS x) GROUP BY ALL),
    t AS (SELECT l_returnflag, x, avg(CASE WHEN l_quantity <= x THEN 1.0::DOUBLE ELSE 0 END) AS v FROM lineitem, (SELECT unnest([10, 25, 40])::DOUBLE AS x) GROUP BY ALL)
    SELECT l_returnflag, round(avg(abs(e - v)), 9) AS mean_cdf_err, round(max(abs(e - v)), 9) AS max_cdf_err FROM s JOIN t USING (l_returnflag, x) GROUP BY 1
""")
def score_cdf_error(spark, sf):
    df = _lines(spark, sf)
    cdf = lambda d: X.group_cdf(d, ["l_returnflag"], "l_quantity", [10, 25, 40])
    e = C.cdf_errors(cdf(df), cdf(T.sampled(df, _row(), 0.1)), ["l_returnflag"])
    return e.withColumn("mean_cdf_err", F.round("mean_cdf_err", 9)).withColumn("max_cdf_err", F.round("max_cdf_err", 9))


@query(f"""
    WITH {_GRID}, {registers_sql('g1', 'gridded', 'l_suppkey', 6, 'gr, gc')}, h AS ({classic_sql('g1', 6, 'gr, gc')}), e AS (SELECT grp, round(min(estimate), 6) AS e FROM asked JOIN h USING (gr, gc) GROUP BY 1), t AS (SELECT grp, count(DISTINCT l_suppkey) AS t FROM fan GROUP BY 1)
    SELECT count(*) AS groups_scored, 0::BIGINT AS groups_unscored, round(avg(abs(e - t) / t), 9) AS err_mean, round(max(abs(e - t) / t), 9) AS err_max FROM t JOIN e USING (grp)
""")
def score_groups(spark, sf):
    truth = _fanned(_by_labels(spark, sf).select(*LABELS, "l_suppkey").distinct()).groupBy("grp").agg(F.countDistinct("l_suppkey").alias("truth"))
    return C.group_summary(C.aligned(truth, hydra_hll(spark, sf), ["grp"])).withColumn("err_mean", F.round("err_mean", 9)).withColumn("err_max", F.round("err_max", 9))


@query(f"""
    WITH t AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS t FROM lineitem GROUP BY ALL), e AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) / 0.1::DOUBLE AS e FROM {_SAMPLE} GROUP BY ALL)
    SELECT round(max(abs(e - t) / t), 9) AS relative_error, round(avg(abs(e - t) / t), 9) AS relative_error_mean, count(*) AS groups_per_instance, count(*) FILTER (e IS NULL) AS missing_groups FROM t LEFT JOIN e USING (l_returnflag, l_linestatus)
""")
def score_aggregates(spark, sf):
    df = _lines(spark, sf)
    truth = df.groupBy(*LABELS).agg(F.sum("l_quantity").alias("truth"))
    answer = T.sampled(df, _row(), 0.1).groupBy(*LABELS).agg((F.sum("l_quantity") / 0.1).alias("estimate"))
    return C.aggregate_errors(truth, answer, LABELS).withColumn("relative_error", F.round("relative_error", 9)).withColumn("relative_error_mean", F.round("relative_error_mean", 9))
