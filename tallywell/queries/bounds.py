"""What sketches whose answers SQL can't repeat promise about their answers, against exact answers: every row must hold."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import compactors as K
from ..operators import exact as X
from ..operators import heaps as H
from ..operators import scoring as C
from ..operators import sketches as S
from ..operators import stream_sketches as T
from . import query, scores, table
from .sketches import _GRID, COLS, LABELS, _by_labels, _gridded


def _truth(spark, sf):
    return X.frequency(table(spark, sf, "lineitem"), "l_suppkey").select(F.col("key").alias("k"), F.col("n").alias("truth"))


def _holds(pairs, holds):
    """One row: whether there are answers, and what must hold does of each."""
    return pairs.agg((F.count(F.lit(1)) > 0).alias("answered"), F.bool_and(holds).alias("within"))


_HOLDS = "SELECT true AS answered, true AS within"


def _counted(pairs, holds):
    """One row: how many answers there are, and of how many it holds."""
    return pairs.agg(F.count(F.lit(1)).alias("probes"), F.count_if(holds).alias("within"))


def _counted_sql(n: str, source: str) -> str:
    return f"SELECT ({n})::BIGINT AS probes, ({n})::BIGINT AS within FROM {source}"


@query("SELECT unnest([0.01, 0.25, 0.5, 0.75, 0.99])::DOUBLE AS q, true AS within")
def bound_kll_quantile(spark, sf):
    """k = 200: ranks are off by 3 % at most, more than twice what is published for 99 % of sketches."""
    return C.rank_errors(table(spark, sf, "lineitem"), "l_extendedprice", scores.kll_quantile(spark, sf)).select("q", (F.col("rank_error") <= 0.03).alias("within"))


@query("SELECT unnest([5, 10, 20, 30, 40])::DOUBLE AS x, true AS within")
def bound_kll_cdf(spark, sf):
    truth = table(spark, sf, "lineitem").select(F.explode(F.array(*[F.struct(F.lit(float(x)).alias("x"), (F.col("l_quantity") <= x).cast("double").alias("at")) for x in (5, 10, 20, 30, 40)])).alias("s"))
    truth = truth.groupBy("s.x").agg(F.avg("s.at").alias("truth"))
    return truth.join(scores.kll_cdf(spark, sf).withColumn("x", F.col("x").cast("double")), "x").select("x", (F.abs(F.col("share") - F.col("truth")) <= 0.02).alias("within"))


@query("SELECT count(DISTINCT o_custkey) AS distinct_values, true AS within FROM orders")
def bound_theta_distinct(spark, sf):
    both = scores.theta_distinct(spark, sf).crossJoin(X.cardinality(table(spark, sf, "orders"), "o_custkey"))  # one row each
    return both.select("distinct_values", (F.abs(F.col("estimate") / F.col("distinct_values") - 1) <= 0.06).alias("within"))


@query("SELECT DISTINCT o_orderstatus, true AS within FROM orders")
def bound_builtin_hll(spark, sf):
    """2**12 registers: off by five standard errors at most."""
    truth = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("truth"))
    return truth.join(scores.builtin_hll(spark, sf), "o_orderstatus").select("o_orderstatus", (F.abs(F.col("estimate") / F.col("truth") - 1) <= 0.08).alias("within"))


@query(_counted_sql("least(256, count(DISTINCT l_suppkey))", "lineitem"))
def bound_space_saving(spark, sf):
    """No count is below the truth, and none is above it by more than it says."""
    both = scores.space_saving(spark, sf).withColumnRenamed("key", "k").join(_truth(spark, sf), "k", "left")
    return _counted(both, (F.col("n") >= F.coalesce("truth", F.lit(0))) & (F.col("n") - F.col("over") <= F.coalesce("truth", F.lit(0))))


@query(_counted_sql("least(32, count(DISTINCT l_suppkey))", "lineitem"))
def bound_space_saving_cms(spark, sf):
    both = scores.space_saving_cms(spark, sf).withColumnRenamed("l_suppkey", "k").join(_truth(spark, sf), "k")
    return _counted(both, F.col("estimate") >= F.col("truth"))


@query(_counted_sql("least(32, count(DISTINCT l_suppkey))", "lineitem"))
def bound_space_saving_cs(spark, sf):
    """Count Sketch's median of three rows: off by four norms over the root of the columns at most."""
    norm = _truth(spark, sf).agg(F.sqrt(F.sum(F.col("truth").cast("double") * F.col("truth"))).alias("l2"))
    both = scores.space_saving_cs(spark, sf).withColumnRenamed("l_suppkey", "k").join(_truth(spark, sf), "k").crossJoin(F.broadcast(norm))  # one row
    return _counted(both, F.abs(F.col("estimate") - F.col("truth")) <= 4 * F.col("l2") / math.sqrt(COLS))


_CELLS = f"WITH {_GRID} SELECT count(*) AS probes, count(*) AS within FROM (SELECT DISTINCT gr, gc FROM gridded)"


def _cells_of(spark, sf):
    """Rows in the grid cells of their label subsets."""
    return _gridded(_by_labels(spark, sf)).select("gr", "gc", F.col("w").cast("double").alias("w"))


@query(_CELLS)
def bound_hydra_kll(spark, sf):
    """k = 200: the median of each grid cell, among all rows that fall in it, is off by twice the published rank error at most."""
    states = T.kll(_by_labels(spark, sf).withColumn("w", F.col("w").cast("double")), "w", 200, LABELS)
    read = T.kll_quantiles(T.kll_merge(_gridded(states), ["gr", "gc"]), [0.5], ["gr", "gc"])
    return _counted(C.rank_errors(_cells_of(spark, sf), "w", read, ["gr", "gc"]), F.col("rank_error") <= 0.027)


@query(_CELLS.replace("count(*)", "3 * count(*)"))
def bound_hydra_kll_cdf(spark, sf):
    """Shares at three quantities of each grid cell."""
    at, by = [10, 25, 40], ["gr", "gc"]
    states = T.kll(_by_labels(spark, sf).withColumn("w", F.col("w").cast("double")), "w", 200, LABELS)
    read = T.kll_ranks(T.kll_merge(_gridded(states), by), at, by)
    both = X.group_cdf(_cells_of(spark, sf), by, "w", at).withColumnRenamed("share", "truth").join(read.withColumn("x", F.col("x").cast("double")), [*by, "x"])
    return _counted(both, F.abs(F.col("share") - F.col("truth")) <= 0.027)


@query(_HOLDS)
def bound_elastic(spark, sf):
    """What a bucket has let go is counted from above, so no heavy key's count is below the truth."""
    return _holds(scores.elastic(spark, sf).withColumnRenamed("key", "k").join(_truth(spark, sf), "k"), F.col("n") >= F.col("truth"))


@query("SELECT count(*)::BIGINT AS total FROM lineitem")
def bound_coco(spark, sf):
    """Every row is counted for some key, once."""
    return scores.coco(spark, sf).agg(F.sum("n").alias("total"))


@query(_HOLDS)
def bound_approx_topk(spark, sf):
    """1,000 counters: a count is off by a hundredth of all rows at most."""
    rows = table(spark, sf, "lineitem").agg((F.count(F.lit(1)) * 0.01).alias("most"))
    both = scores.approx_topk(spark, sf).select(F.col("item").alias("k"), "count").join(_truth(spark, sf), "k").crossJoin(rows)  # one row
    return _holds(both, F.abs(F.col("count") - F.col("truth")) <= F.col("most"))


@query("SELECT count(DISTINCT l_partkey) AS distinct_values, true AS within FROM lineitem")
def bound_univmon_q_cardinality(spark, sf):
    """64 keys a layer: off by half at most, four standard errors of a sample of that size."""
    both = scores.univmon_q_cardinality(spark, sf).crossJoin(X.cardinality(table(spark, sf, "lineitem"), "l_partkey"))  # one row each
    return both.select("distinct_values", (F.abs(F.col("estimate") / F.col("distinct_values") - 1) <= 0.5).alias("within"))


@query("SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS q, true AS within")
def bound_univmon_q_quantile(spark, sf):
    """A sample of 128 to 256 keys, and weights off by the sketch's error: ranks are off by 15 % at most."""
    return C.rank_errors(table(spark, sf, "lineitem").withColumn("k", F.col("l_partkey").cast("double")), "k", scores.univmon_q_quantile(spark, sf).withColumn("value", F.col("value").cast("double"))).select("q", (F.col("rank_error") <= 0.15).alias("within"))


_RANKS = [0.01, 0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 0.99]


@query(f"SELECT unnest([1, 8]) AS shards, count(*) AS n, min(l_extendedprice) AS least, max(l_extendedprice) AS largest, {len(_RANKS)}::BIGINT AS within FROM lineitem")
def bound_kll_dynamic(spark, sf):
    """Compactors with k = 200, of one shard and merged from eight: what they stand for, and how many of nine ranks are within the published error."""
    df, out = table(spark, sf, "lineitem").withColumn("shard", F.col("l_orderkey") % 8), None
    for shards in (1, 8):
        one = df if shards == 8 else df.withColumn("shard", F.lit(0).cast("long"))
        state = K.merge(K.sketch(one, "l_extendedprice", 200, shard="shard"), 200, shards=shards)
        off = C.rank_errors(df, "l_extendedprice", K.quantiles(state, _RANKS)).agg(F.count_if(F.col("rank_error") <= K.rank_error(200)).alias("within"))
        row = K.kept(state).select(F.lit(shards).alias("shards"), "n", "least", "largest").crossJoin(off)  # one row each
        out = row if out is None else out.union(row)
    return out


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS largest, 5::BIGINT AS within FROM lineitem GROUP BY ALL")
def bound_kll_dynamic_groups(spark, sf):
    """By group, shares at five quantities; each is within the published error of the exact share."""
    by, at = ["l_returnflag", "l_linestatus"], [5, 10, 20, 30, 40]
    df = table(spark, sf, "lineitem")
    state = K.merge(K.sketch(df, "l_quantity", 400, by), 400, by)
    off = X.group_cdf(df, by, "l_quantity", at).withColumnRenamed("share", "truth").join(K.ranks(state, at, by), [*by, "x"])
    within = off.groupBy(*by).agg(F.count_if(F.abs(F.col("share") - F.col("truth")) <= K.rank_error(400)).alias("within"))
    return K.kept(state, by).select(*by, "n", "least", "largest").join(within, by)


@query("WITH f AS (SELECT l_suppkey, sum(l_quantity)::DOUBLE AS w FROM lineitem GROUP BY 1) SELECT count(*) AS cardinality, sum(w) AS l1, true AS cardinality_within, true AS l1_within, true AS l2_within, true AS entropy_within FROM f")
def bound_univmon_stream(spark, sf):
    """UnivMon in one pass, 256 keys a layer: cardinality and l1 off by a quarter at most, l2 by a tenth, entropy by a tenth."""
    df = table(spark, sf, "lineitem")
    got = S.univmon_statistics(H.univmon_pass(df, "l_suppkey", F.col("l_quantity"), 10, 5, 1024, 256)[1], 10)
    exact = X.keyed(df, "l_suppkey", "l_quantity").toDF("cardinality", "l1", "l2", "entropy")
    near = lambda c, e: (F.abs(F.col(f"e.{c}") / F.col(f"x.{c}") - 1) <= e).alias(f"{c}_within")
    both = exact.alias("x").crossJoin(got.alias("e"))  # one row each
    return both.select("x.cardinality", "x.l1", near("cardinality", 0.25), near("l1", 0.25), near("l2", 0.1), near("entropy", 0.1))
