"""Hand-checkable cases, null and exact estimators, metamorphic checks and refusals."""

import math

import pytest
from pyspark.sql import functions as F

from tallywell.functions.hashing import integer_key
from tallywell.model import Roles, Unsupported, subset_key
from tallywell.operators import exact as X
from tallywell.operators import rules as R
from tallywell.operators import scoring as C
from tallywell.operators import sketches as S
from tallywell.operators import stream_sketches as T
from tallywell.operators import study as D
from tallywell.operators import windows as V
from tallywell.plans import panes as P

SIX = [("a", "x", 10), ("a", "y", 10), ("a", "x", 20), ("b", "x", 30), ("b", "y", 30), ("b", "y", 30)]


def test_groups(spark):
    df = spark.createDataFrame(SIX, "key1 string, key2 string, value long")
    got = {r.key1: (r.distinct_values, r.l1, round(r.l2, 9), round(r.entropy, 9)) for r in X.group_shape(df, ["key1"], "value").collect()}
    assert got["a"][:3] == (2, 3, round(math.sqrt(5), 9)) and got["b"] == (1, 3, 3.0, 0.0)
    assert X.subsets(df, ["key1", "key2"], F.count(F.lit(1)).alias("n")).count() == 8 == X.fan_out(df, ["key1", "key2"]).groupBy("subset", "key1", "key2").count().count()


def test_increase_with_reset(spark):
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate([1, 5, 2, 4])], "k string, i int, v double")
    assert X.increase(df, ["k"], ["i"], "v").first().increase == 8.0


def test_double_keys_are_bits(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),)], "v double")
    assert X.cardinality(df, "v").first()[0] == 3


def test_refusals(spark):
    df = spark.createDataFrame(SIX, "key1 string, key2 string, value long")
    for bad in (lambda: X.quantiles(df, "value", [0.5], "middle"), lambda: Roles(("nope",)).of(df), lambda: V.over_time(df, V.Grid(0, 0, 1), 1, "mode", []), lambda: P.merge(df, 7, V.Grid(10, 20, 5), 14, []), lambda: D.choose("entropy", 0.1), lambda: S.dd_buckets(df, "value", 1.5)):
        with pytest.raises(Unsupported):
            bad()
    with pytest.raises(Exception, match="negative"):
        X.group_sum(spark.createDataFrame([("a", -1)], "k string, v long"), ["k"], "v").collect()


def test_subset_key(spark):
    df = spark.createDataFrame([("a;b", None, "c:d\\")], "x string, y string, z string")
    assert df.select(subset_key({c: F.col(c) for c in "xyz"})).first()[0] == r"x:a\;b;z:c\:d\\"


def test_windows_are_left_open(spark):
    df = spark.createDataFrame([("s", i * 10, 1.0) for i in range(1, 7)], "k string, ts_ms long, value double")
    got = V.over_time(df, V.Grid(10, 60, 10), 10, "count", ["k"]).collect()
    assert sorted((r.t, r.value) for r in got) == [(t, 1.0) for t in range(10, 61, 10)]
    assert V.Grid.after_warmup(5, 100, 20, 10).first == 30


def test_instant_takes_the_latest_in_the_lookback(spark):
    t = 100_000
    rows = [("a", "s1", t - 10, 100.0), ("a", "s1", t - 3, 1.0), ("a", "s2", t - 5, 9.0), ("a", "s3", t, 2.0), ("b", "s4", t - 1, 4.0)]
    df = spark.createDataFrame(rows, "job string, s string, ts_ms long, value double")
    got = V.aggregate(V.instant(df, V.Grid(t, t, 1), 5, ["job", "s"]), "sum", ["job"])
    assert {r.job: r.value for r in got.collect()} == {"a": 3.0, "b": 4.0}
    assert V.aggregate(V.instant(df, V.Grid(1, 1, 1), 1, ["job", "s"]), "sum").count() == 0  # no row for nothing


def test_topk_puts_nan_last(spark):
    df = spark.createDataFrame([(0, f"i{r}", float(r)) for r in range(1, 6)] + [(0, "i6", float("nan"))], "t long, i string, value double")
    assert sorted(r.i for r in V.topk(df, 2, ["i"]).collect()) == ["i4", "i5"]
    assert "i6" not in {r.i for r in V.topk(df, 5, ["i"]).collect()}


def test_panes_equal_samples_and_refuse_overlap(spark):
    df = spark.createDataFrame([("s", 7 * i, float(i * 37 % 11)) for i in range(1, 90)], "k string, ts_ms long, value double")
    grid = V.Grid(200, 600, 20)
    raw = V.increase_over(df, grid, 100, ["k"]).select("t", F.round("value", 9))
    stored = P.increase_of(P.merge(P.build(df, 20, ["k"]), 20, grid, 100, ["k"]), 100, ["k"]).select("t", F.round("value", 9))
    assert raw.exceptAll(stored).count() == stored.exceptAll(raw).count() == 0
    rolled = P.roll_up(P.build(df, 20, ["k"]), 100, ["k"]).select("window_end", "n", "first", "last", "dropped")
    assert rolled.exceptAll(P.build(df, 100, ["k"]).select("window_end", "n", "first", "last", "dropped")).count() == 0
    twice = P.build(df, 20, ["k"])
    with pytest.raises(Exception, match="overlap"):
        P.merge(twice.union(twice), 20, grid, 100, ["k"]).collect()


def test_null_and_exact_estimators(spark):
    truth = X.frequency(spark.createDataFrame([(i % 7,) for i in range(100)], "v long"), "v").toDF("v", "truth")
    for estimate, want in ((F.lit(0), 1.0), (F.col("truth"), 0.0)):
        curve = C.curve(C.aligned(truth, truth.select("v", estimate.alias("estimate")), ["v"]), ["v"])
        assert {r.are for r in curve.collect()} == {want}
    assert C.error_percentile(C.aligned(truth, truth.select("v", F.lit(0).alias("estimate")), ["v"]), 0.99).first()[0] == 1.0
    top = truth.limit(3)
    got = C.top_sets(top, top.withColumnRenamed("truth", "estimate"), "v").first()
    assert (got.precision_at_k, got.recall_at_k, got.max_count_err) == (1.0, 1.0, 0.0)


def test_shards_merge_to_the_whole(spark):
    df = spark.range(5000).select((F.col("id") % 97).alias("v"), (F.col("id") % 3).alias("shard"))
    key = integer_key(F.col("v"))
    for signed in (False, True):
        whole = S.matrix(df, key, 3, 64, signed).filter("n != 0")
        assert whole.exceptAll(S.merge_cells(S.matrix(df, key, 3, 64, signed, by=["shard"])).filter("n != 0")).count() == 0
    e = S.estimate(S.matrix(df, key, 3, 64), df.select("v").distinct(), key, 3, 64).join(df.groupBy("v").count(), "v")
    assert e.filter("estimate < count").count() == 0


def test_bounds_of_sketches(spark):
    df = spark.range(20000).select((F.col("id") * F.col("id") % 5003).alias("v"))
    n = df.distinct().count()
    key = integer_key(F.col("v"))
    for e in (S.hll_estimate(S.registers(df, key, 10), 10), S.hll_ertl(S.registers(df, key, 10), 10), S.kmv_estimate(S.least_hashes(df, key, 512), 512), T.hll_hip(df.withColumn("i", F.monotonically_increasing_id()), key, ["i"], 10)):
        assert abs(e.first()[0] / n - 1) < 0.2
    got = {r.key: (r.n, r.over) for r in T.space_saving(df.select((F.col("v") % 50).alias("v")), "v", 64).collect()}
    truth = {r.v: r["count"] for r in df.select((F.col("v") % 50).alias("v")).groupBy("v").count().collect()}
    assert all(n - over <= truth[k] <= n for k, (n, over) in got.items())
    dd = {r.q: r.value for r in S.dd_quantiles(S.dd_buckets(df.select((F.col("v") + 1).cast("double").alias("v")), "v", 0.01), 0.01, [0.5, 0.99]).collect()}
    order = {r.q: r.value for r in X.quantiles(df.select((F.col("v") + 1).cast("double").alias("v")), "v", [0.5, 0.99], "order").collect()}
    assert all(abs(dd[q] / order[q] - 1) <= 0.0101 for q in dd)


def test_space_saving_when_full(spark):
    df = spark.range(3000, numPartitions=3).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"))
    top = T.space_saving(df, "v", 32).first()
    assert top.key == 7 and top.n >= 1001 >= top.n - top.over


def test_sequential_rules(spark):
    def flags(values, f, kind="double"):
        df = spark.createDataFrame([(e, i, v) for e in ("a", "b") for i, v in enumerate(values)], f"entity string, t int, v {kind}")
        got = f(df).orderBy("entity", "t").collect()
        assert [r.on for r in got[: len(values)]] == [r.on for r in got[len(values) :]]
        return [r.on for r in got[: len(values)]]

    latch = lambda values, *a, **b: flags(values, lambda df: R.latch(df, "v", "on", *a, **b), "boolean")
    assert latch([True, False, False, True, True, False, False], 2) == [True, True, False, True, True, True, False]
    assert latch([True, True, True, False], 2, extend=False) == [True, True, True, True]
    assert latch([True, False, True, None, False], 3, extend=False) == [True, True, True, False, False]
    assert latch([True, True, True, False], 1, extend=False, while_held=True) == [True, True, True, False]
    cusum = lambda values: flags(values, lambda df: R.cusum(df, "v", "on", 3, 0.5, 1))
    assert cusum([1.0, 2.0, 3.0, 2.0, 9.0, None, 0.0]) == [False, False, False, False, True, False, False]
    assert cusum([1.0, None, 3.0, 9.0]) == [False] * 4
    band = lambda values: flags(values, lambda df: R.above_decayed_band(df, "v", "on", 0.9, 1, 2))
    assert band([1.0, 1.0, 5.0, None]) == [False, False, True, False]
    assert band([1.0, None, float("nan"), 1.0, 0.5, 2.0]) == [False, False, False, False, False, True]


def test_holds_and_actions(spark):
    df = spark.createDataFrame([("e", i, v) for i, v in enumerate([1.0, None, 9.0, 9.0, 9.0, 1.0])], "entity string, t int, v double")
    df = df.withColumn("hit", R.above("v", 5))
    assert [r[0] for r in df.select(R.for_consecutive("hit", 2), "t").orderBy("t").collect()] == [False, False, False, True, True, False]
    acted = spark.createDataFrame([("e", i, e, a) for i, (e, a) in enumerate([("none", "none"), ("up", "none"), ("none", "up"), ("down", "none"), ("none", "none"), ("none", "up")])], "entity string, t int, exact string, approx string")
    got = {(r.action, r.exact_at, r.approx_at) for r in R.matched_actions(acted).collect()}
    assert got == {("up", 1, 2), ("down", 3, None), ("up", None, 5)}
    both = [("up", "none"), ("up", "up"), ("up", "up"), ("none", "none"), ("down", "up"), ("none", "down"), ("down", "none")]
    acted = spark.createDataFrame([("e", i, e, a) for i, (e, a) in enumerate(both)], "entity string, t int, exact string, approx string")
    got = {(r.action, r.exact_at, r.approx_at) for r in R.matched_actions(acted).collect()}
    assert got == {("up", 1, 1), ("up", 2, 2), ("up", 0, None), ("up", None, 4), ("down", 4, 5), ("down", 6, None)}


def test_confusion_of_equal_arms_is_clean(spark):
    on = spark.createDataFrame([("e", i, i % 3 == 0) for i in range(9)], "entity string, t int, state boolean")
    s = R.spine(on, on)
    assert R.confusion(s).first().agreement == 1.0 and R.false_spans(s).count() == 0
    assert {(r.evaluations, r.onset_delay, r.gaps) for r in R.episodes(s).collect()} == {(1, 0, 0)}


def test_cost_fit_and_error_quantile(spark):
    pts = spark.createDataFrame([("i", 1e3, 60000.0), ("i", 1e4, 510000.0), ("i", 1e5, 5010000.0)], "w string, x double, y double")
    f = D.cost_fit(pts, ["w"]).first()
    assert abs(f.slope - 50) < 1e-6 and abs(f.intercept - 10000) < 1e-2 and not f.flagged
    e = spark.createDataFrame([("a", float(i)) for i in range(1, 101)], "w string, error double")
    assert D.error_quantiles(e, ["w"], [0.57, 0.01]).collect()[0].error == 43.0
    with pytest.raises(Exception, match="even"):
        D.noise_band(e, ["w"], "error").collect()


def test_choice_meets_its_target():
    for c in ("frequency", "cardinality", "quantile", "relative-quantile"):
        for e in (0.2, 0.05, 0.01):
            assert D.choose(c, e)["bound"] <= e
    assert D.choose("cardinality", 1e-5)["sketch"] == "exact"


def test_estimates_by_group_move_no_probes(spark):
    """Matrices by group are broadcast: no probe is shuffled, and repeated probes, groups without a matrix and null keys keep their rows."""
    rows = [(g, k, 1 + (g * k) % 5) for g in range(4) for k in range(60)]
    df = spark.createDataFrame(rows, "g int, k long, w long")
    probes = spark.createDataFrame([(g, k) for g in range(5) for k in range(60)] + [(1, 7), (2, None)], "g int, k long")
    for signed in (False, True):
        cells = S.matrix(df, F.col("k"), 3, 32, signed, F.col("w"), by=["g"])
        got = S.estimate(cells.localCheckpoint(), probes.localCheckpoint(), F.col("k"), 3, 32, signed, by=["g"])
        for g in range(5):
            one = S.estimate(cells.filter(F.col("g") == g).drop("g"), probes.filter((F.col("g") == g) & F.col("k").isNotNull()), F.col("k"), 3, 32, signed)
            assert sorted(map(tuple, got.filter((F.col("g") == g) & F.col("k").isNotNull()).collect())) == sorted(map(tuple, one.collect()))
        assert got.count() == probes.count() and got.filter("k IS NULL").first().estimate == 0
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
