"""Published rules and rollout controllers on hand-made evaluations."""

from pyspark.sql import functions as F

from tallywell.operators import published as U
from tallywell.operators import rules as R


def evaluations(spark, values, column="p95"):
    return spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], f"entity string, t int, {column} double")


def test_only_passing_evaluations_join_the_baseline(spark):
    df = evaluations(spark, [0.4, 0.5, 0.43, None, 0.46, 0.47, 0.6])
    got = U.slower_than_passing(df, "p95", "failed", 1.1, 0.6, 3).orderBy("t")
    # 0.5 > 1.1 * 0.4; 0.43 passes, so the mean is 0.415 and 0.46 is above 0.4565; 0.47 too; 0.6 is too much anyway
    assert [r.failed for r in got.collect()] == [False, True, False, False, True, True, True]


def test_decided_at_the_first_end(spark):
    flags = [False] * 3 + [True] + [False] * 4 + [True, True, True, False, True, False, False, False]
    df = evaluations(spark, [0.0] * 16).join(spark.createDataFrame(list(enumerate(flags)), "t int, failed boolean"), "t")
    got = U.decided(df, "failed", 8, lambda fails, row, passes, recent: row >= 3, lambda passes: passes >= 4).orderBy("rollout")
    assert [(r.rollout, r.decision, r["at"]) for r in got.collect()] == [(0, "promote", 4), (1, "rollback", 10)]


def test_what_is_left_over_is_no_rollout(spark):
    df = evaluations(spark, [0.0] * 7).withColumn("failed", F.lit(False))
    assert U.decided(df, "failed", 8, lambda fails, row, passes, recent: row >= 3).count() == 0


def test_missing_values_meet_no_condition(spark):
    df = evaluations(spark, [None, 600.0, None, None], "top10_clients_1m").withColumn("top10_clients", F.lit(None).cast("double"))
    got = {(r.rule, r.t): r.state for r in U.judged(df, U.rate_limits(armor_minutes=2)).collect()}
    assert [got["cloud_armor", t] for t in range(4)] == [False, True, True, False]
    assert not any(got["aws_waf", t] or got["fastly", t] for t in range(4))


def test_rules_that_lack_a_column_are_left_out():
    assert set(U.answerable(U.video(), ["entity", "t", "buffering_l1", "startup_p95", "sessions"])) == {"hydra", "conviva_ai"}


def test_decayed_band_outlasts_any_history(spark):
    values = [1.0 + i % 2 for i in range(3000)] + [9.0, None, 1.0]
    got = R.above_decayed_band(evaluations(spark, values, "v"), "v", "state", 0.5, 2, 3)
    assert [r.t for r in got.filter("state").collect()] == [3000]
