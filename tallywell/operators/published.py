"""Alert, ban and rollout rules that operators publish, as sets over named columns of evaluations (entity, t, ...).

A rule is a condition on an evaluation, given what came before, and what the
state holds on to after it. A set of rules is judged in one pass: all windows are
over the same entities in the same order, so evaluations are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rules as R

Step = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Rule:
    """reads: the columns it needs; when(df, out): df with the condition; hold(df, flag, out): df with the state."""

    reads: tuple[str, ...]
    when: Step
    hold: Callable[[DataFrame, str, str], DataFrame] | None = None


def holds(condition: Callable[[], Column]) -> Step:
    return lambda df, out: df.withColumn(out, condition())


def held(hold: Callable[[str], Column]) -> Callable[[DataFrame, str, str], DataFrame]:
    return lambda df, flag, out: df.withColumn(out, hold(flag))


def latched(evaluations: int, **how) -> Callable[[DataFrame, str, str], DataFrame]:
    return lambda df, flag, out: R.latch(df, flag, out, evaluations, **how)


def also(step: Step, condition: Callable[[], Column]) -> Step:
    return lambda df, out: step(df, out).withColumn(out, F.col(out) & condition())


def answerable(rules: dict[str, Rule], columns: list[str]) -> dict[str, Rule]:
    """The rules whose columns are all there."""
    return {name: r for name, r in rules.items() if set(r.reads) <= set(columns)}


def judged(evaluations: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """(rule, entity, t, state) of every rule at every evaluation. A missing value never meets a condition."""
    df = evaluations
    for name, rule in rules.items():
        if rule.hold is None:
            df = rule.when(df, name)
        else:
            df = rule.hold(rule.when(df, f"_{name}"), f"_{name}", name).drop(f"_{name}")
    return df.unpivot([R.ENTITY, R.TIME], list(rules), "rule", "state").select("rule", R.ENTITY, R.TIME, "state")


# Thresholds, windows and holds as their operators publish them. Each can be passed anew.


def syn_flood(entropy=8.5, distinct=3000, distinct_short=1700, history=60, sigmas=3, factor=2.0, training=50, slack=0.5, alarm=5, packets_per_s=20_000, ban_s=1900, flows_per_s=300, for_s=15, step_s=5) -> dict[str, Rule]:
    """Floods of one server, over entropy and distinct sources in 10 s, distinct sources in 5 s and 1 min, packets in 5 s.

    step_s: the time between evaluations; a ban's length and the time that a condition must have held follow from it.
    """
    packets, flows, ban, consecutive = 5 * packets_per_s, 60 * flows_per_s, ban_s // step_s, for_s // step_s + 1
    any_of = lambda: R.above("entropy_10s", entropy) | R.above("distinct_10s", distinct) | R.above("distinct_5s", distinct_short)
    return {
        "promsketch_for_15s": Rule(("entropy_10s", "distinct_10s", "distinct_5s"), holds(any_of), held(lambda f: R.for_consecutive(f, consecutive))),
        "datadog": Rule(("distinct_10s",), holds(lambda: R.above_band("distinct_10s", history, sigmas))),
        "kentik": Rule(("distinct_10s",), holds(lambda: R.above_mean_times("distinct_10s", history, factor)), held(lambda f: R.x_of_last_y(f, 3, 6))),
        "netflow_logic": Rule(("entropy_10s",), lambda df, out: R.cusum(df, "entropy_10s", out, training, slack, alarm)),
        "fastnetmon": Rule(("packets_5s",), holds(lambda: R.above("packets_5s", packets)), latched(ban, extend=False, while_held=True)),
        "red_hat": Rule(("distinct_1m",), holds(lambda: R.above("distinct_1m", flows)), held(lambda f: R.for_consecutive(f, consecutive))),
    }


def video(history=30, sigmas=3, rebuffering=0.05, start=4.0, viewers=100, long_history=360, plays=25, suppressed=60, decay=0.998, minutes=5, devices=100) -> dict[str, Rule]:
    """Experience of one subpopulation of viewers, by minute."""
    worse = lambda: (R.above("rebuffer_ratio", rebuffering) | R.above("startup_p95", start)) & R.at_least("sessions", viewers)
    return {
        "hydra": Rule(("buffering_l1",), holds(lambda: R.above_band("buffering_l1", history, sigmas))),
        "hydra_entropy": Rule(("entropy_bitrate",), holds(lambda: R.outside_band("entropy_bitrate", history, sigmas))),
        "mux": Rule(("rebuffer_ratio", "startup_p95", "sessions"), holds(worse)),
        "conviva_ai": Rule(("startup_p95", "sessions"), holds(lambda: R.above_band("startup_p95", long_history, sigmas, history) & R.at_least("sessions", plays)), latched(suppressed, extend=False)),
        "conviva_patent": Rule(("rebuffer_ratio", "distinct_devices"), also(lambda df, out: R.above_decayed_band(df, "rebuffer_ratio", out, decay, sigmas, history), lambda: R.at_least("distinct_devices", devices)), held(lambda f: R.for_consecutive(f, minutes))),
    }


def rate_limits(waf=2000, armor=500, armor_minutes=10, fastly=1200, fastly_minutes=2) -> dict[str, Rule]:
    """Clients among the top 10, by requests in 5 minutes and in 1."""
    return {
        "aws_waf": Rule(("top10_clients",), holds(lambda: R.above("top10_clients", waf))),
        "cloud_armor": Rule(("top10_clients_1m",), holds(lambda: R.above("top10_clients_1m", armor)), latched(armor_minutes)),
        "fastly": Rule(("top10_clients_1m",), holds(lambda: R.above("top10_clients_1m", fastly)), latched(fastly_minutes)),
    }


# -- rollouts ------------------------------------------------------------------------------------------------------


def every(df: DataFrame, n: int) -> DataFrame:
    """The first evaluation of an entity and each n-th after it."""
    w = W.partitionBy(R.ENTITY).orderBy(R.TIME)
    return df.withColumn("_i", F.row_number().over(w) - 1).filter(F.col("_i") % n == 0).drop("_i")


def slower_than_passing(df: DataFrame, value: str, out: str, relative: float, most: float, passing: int) -> DataFrame:
    """``value`` is at least ``most``, or above ``relative`` times the mean of the last ``passing`` evaluations that had neither.

    A missing value fails nothing and joins no baseline.
    """

    def step(state: Column, row: Column) -> tuple[dict[str, Column], Column]:
        kept, v = state["kept"], row[value]
        sum_ = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)
        failed = R._true(v >= most) | R._true((F.size(kept) > 0) & (v > relative * sum_ / F.size(kept)))
        now = F.when(v.isNull() | failed, kept).otherwise(F.slice(F.concat(F.array(v), kept), 1, passing))
        return {"kept": now}, failed

    return R.carried(df.withColumn(value, F.col(value).cast("double")), out, {"kept": F.array().cast("array<double>")}, step)


def decided(df: DataFrame, failed: str, checks: int, rollback: Callable[[Column, Column, Column, Column], Column], promote: Callable[[Column], Column] | None = None) -> DataFrame:
    """(entity, rollout, decision, at): each ``checks`` evaluations are one rollout, and what is left over is none.

    It is decided at the first evaluation where ``rollback`` holds of (failures so far, failures in a row, passes so
    far, failures among the last 5), or ``promote`` of passes so far; otherwise it is promoted at the last.
    """
    w = W.partitionBy(R.ENTITY).orderBy(R.TIME)
    r = df.withColumn("i", F.row_number().over(w) - 1).withColumn("rollout", F.floor(F.col("i") / checks))
    part = W.partitionBy(R.ENTITY, "rollout").orderBy("i")
    f, so_far = F.col(failed).cast("int"), part.rowsBetween(W.unboundedPreceding, 0)
    r = r.withColumn("fails", F.sum(f).over(so_far)).withColumn("passes", F.sum(1 - f).over(so_far)).withColumn("recent", F.sum(f).over(part.rowsBetween(-4, 0)))
    r = r.withColumn("last_pass", F.max(F.when(f == 0, F.col("i"))).over(so_far))
    row = F.col("i") - F.coalesce("last_pass", F.col("rollout") * checks - 1)
    no = rollback(F.col("fails"), row, F.col("passes"), F.col("recent"))
    yes = promote(F.col("passes")) if promote else F.lit(False)
    r = r.withColumn("ends", F.when(no, "rollback").when(yes, "promote"))
    ended = F.col("ends").isNotNull()
    one = r.groupBy(R.ENTITY, "rollout").agg(F.min_by("ends", F.when(ended, F.col("i"))).alias("first"), F.min(F.when(ended, F.col("i"))).alias("hit"), F.max("i").alias("last"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == checks)
    return one.select(R.ENTITY, "rollout", F.when(F.col("hit").isNull(), "promote").otherwise(F.col("first")).alias("decision"), F.coalesce("hit", "last").alias("at"))


def controllers(df: DataFrame, p99: float = 0.5, success: float = 0.99, argo: float = 0.95, p95: float = 0.6, tolerance: float = 1.1) -> DataFrame:
    """(controller, entity, rollout, decision, at) over p99, p99_stable, success_rate and p95 of a canary; at counts a controller's own evaluations."""
    t = R._true
    slow = df.withColumn("failed", t(F.try_divide("p99", "p99_stable") > tolerance))
    bad = df.withColumn("failed", t(F.col("p99") > p99) | t(F.col("success_rate") < success))
    rare = every(df, 5).withColumn("failed", t(F.col("success_rate") < argo))
    breach = df.withColumn("failed", t(F.col("p99") > p99))
    worse = slower_than_passing(every(df, 10), "p95", "failed", tolerance, p95, 3)
    found = {
        "three_in_a_row": decided(slow, "failed", 10, lambda fails, row, passes, recent: row >= 3),
        "flagger": decided(bad, "failed", 34, lambda fails, row, passes, recent: fails >= 10, lambda passes: passes >= 25),
        "argo_rollouts": decided(rare, "failed", 10, lambda fails, row, passes, recent: fails > 3),
        "cloudwatch": decided(breach, "failed", 10, lambda fails, row, passes, recent: recent >= 4),
        "keptn": decided(worse, "failed", 1, lambda fails, row, passes, recent: fails >= 1),
    }
    parts = [d.select(F.lit(name).alias("controller"), "*") for name, d in found.items()]
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out
