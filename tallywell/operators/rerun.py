"""Checks over answers with error intervals, and what becomes of those that an interval leaves open.

An answer is (entity, t, value, low, high): the approximate answer, and an
interval that the exact one is in. A check adds a boolean column, null where the
interval leaves it open. Comparing an interval gives true, false or null, and and/or of
conditions are SQL's, so "one of" and "all of" know what is open too. History (means,
deviations) is of the values, not the intervals; sums that are carried along have a lower and an upper one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Unsupported
from ..storage import save
from .rules import ENTITY, TIME, carried, history, interval_gt, interval_lt

ANSWER = (ENTITY, TIME, "value", "low", "high")
#: Adds the named boolean column.
Check = Callable[[DataFrame, str], DataFrame]


# -- intervals -----------------------------------------------------------------------------------------------------


def widened(answers: DataFrame, metric: str, error: float, companions: DataFrame | None = None) -> DataFrame:
    """answers(entity, t, value) with low and high, by what their error is bounded in.

    relative: |estimate - exact| <= error * exact. absolute: <= error. rank: a
    quantile whose rank is off by ``error`` at most, with companions(entity, t,
    below, above), the same sketch's answers at phi - error and phi + error; where they are missing the answer stands bare.
    A null answer has a null interval.
    """
    v = F.col("value")
    if metric == "relative":
        ends = [v / (1 + error), v / (1 - error) if error < 1 else F.when(v.isNotNull(), F.signum(v) * float("inf"))]
        return answers.select(ENTITY, TIME, "value", F.least(*ends).alias("low"), F.greatest(*ends).alias("high"))
    if metric == "absolute":
        return answers.select(ENTITY, TIME, "value", (v - error).alias("low"), (v + error).alias("high"))
    if metric != "rank" or companions is None:
        raise Unsupported(f"error metric {metric}", "not relative, absolute, or rank with companions")
    both = answers.join(companions, [ENTITY, TIME], "left")
    there = F.col("below").isNotNull() & F.col("above").isNotNull()
    return both.select(ENTITY, TIME, "value", F.when(there, F.least("below", "value")).otherwise(v).alias("low"), F.when(there, F.greatest("above", "value")).otherwise(v).alias("high"))


def companion_ranks(q: float, error: float) -> list[float]:
    """The quantiles to read beside q, and q."""
    return [max(0.0, q - error), q, min(1.0, q + error)]


def from_quantiles(read: DataFrame, q: float, error: float) -> tuple[DataFrame, DataFrame]:
    """read(entity, t, q, value) at companion_ranks -> answers and companions."""
    low, mid, high = companion_ranks(q, error)
    at = lambda x: F.max(F.when(F.col("q") == x, F.col("value")))
    wide = read.groupBy(ENTITY, TIME).agg(at(low).alias("below"), at(mid).alias("value"), at(high).alias("above"))
    return wide.select(ENTITY, TIME, "value"), wide.select(ENTITY, TIME, "below", "above")


def ratio(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """The interval of a / b: that of its corners, and everything where b's interval holds 0."""
    corners = [F.try_divide(x, y) for x in a for y in b]
    zero, known = (b[0] <= 0) & (b[1] >= 0), a[0].isNotNull() & b[0].isNotNull()
    inf = float("inf")
    return F.when(known, F.when(zero, -inf).otherwise(F.least(*corners))), F.when(known, F.when(zero, inf).otherwise(F.greatest(*corners)))


# -- checks --------------------------------------------------------------------------------------------------------


def threshold(least: float) -> Check:
    return lambda df, out: df.withColumn(out, interval_gt(F.col("low"), F.col("high"), F.lit(float(least))))


def band(size: int, k: float, minimum: int | None = None, both_sides: bool = False) -> Check:
    """Above (or beside) the mean of the last ``size`` values by k deviations; false without enough of them."""

    def check(df: DataFrame, out: str) -> DataFrame:
        centre, spread = history("value", size, minimum)
        rows = df.withColumn("_up", centre + k * spread).withColumn("_down", centre - k * spread)
        flag = interval_gt(F.col("low"), F.col("high"), F.col("_up"))
        flag = flag | interval_lt(F.col("low"), F.col("high"), F.col("_down")) if both_sides else flag
        return rows.withColumn(out, F.when(F.col("_up").isNull(), False).otherwise(flag)).drop("_up", "_down")

    return check


def cusum(training: int, k: float, h: float) -> Check:
    """rules.cusum over intervals: a lower sum of the lower ends and an upper one of the upper ends. True while the lower is above
    h deviations, false while the upper isn't, open between."""

    def check(df: DataFrame, out: str) -> DataFrame:
        known = lambda c: F.when(~F.isnan(F.col(c)), F.col(c))
        rows = df.withColumns({"_v": known("value"), "_l": known("low"), "_h": known("high"), "_i": F.row_number().over(W.partitionBy(ENTITY).orderBy(TIME))})
        first, of = F.when(F.col("_i") <= training, F.col("_v")), W.partitionBy(ENTITY)
        enough = F.count(first).over(of) == training
        rows = rows.withColumn("_mean", F.when(enough, F.avg(first).over(of))).withColumn("_sd", F.when(enough, F.stddev_pop(first).over(of)))

        def step(state: Column, row: Column) -> tuple[dict[str, Column], Column]:
            counts = (row["_i"] > training) & row["_v"].isNotNull() & row["_mean"].isNotNull()
            limit = h * row["_sd"]
            moved = lambda s, end: F.when(counts, F.least(2 * limit, F.greatest(F.lit(0.0), s + row[end] - row["_mean"] - k * row["_sd"]))).otherwise(s)
            low, high = moved(state["low"], "_l"), moved(state["high"], "_h")
            return {"low": low, "high": high}, F.when(~counts, False).when(low > limit, True).when(high <= limit, False)

        return carried(rows, out, {"low": F.lit(0.0), "high": F.lit(0.0)}, step, unknown=True).drop("_v", "_l", "_h", "_i", "_mean", "_sd")

    return check


# -- policies ------------------------------------------------------------------------------------------------------


def _bare(answers: DataFrame) -> DataFrame:
    """Answers whose interval is the answer."""
    return answers.select(ENTITY, TIME, "value", F.col("value").alias("low"), F.col("value").alias("high"))


def judge(answers: DataFrame, check: Check, policy: str, exact: Callable[[DataFrame], DataFrame] | None = None, default: bool = False) -> DataFrame:
    """(entity, t, state, open, rerun): the check's decisions. open: an interval left it open in the end; rerun: it was asked anew, exactly.

    plain: intervals are disregarded. bound: an open check takes the default.
    rerun: the exact plan answers open evaluations, and those alone: exact(keys)
    gives (entity, t, value) for a table of (entity, t). Answers that come back
    replace value and interval, and all checks of an entity that got some are judged
    again, since they look back on them; that goes on until no open one is new. What is open
    even so, because of earlier intervals, takes the check of exact answers alone.

    Each round reruns at least one evaluation of each entity in it, and entities
    without a new open one leave, so later rounds are small. A round is one
    shuffle by entity, written to the shared folder. An evaluation that the exact plan has no answer for is null from then on.
    """
    rows = answers.select(*ANSWER)
    if policy == "plain":
        return check(_bare(rows), "_c").select(ENTITY, TIME, F.coalesce("_c", F.lit(default)).alias("state"), F.col("_c").isNull().alias("open"), F.lit(False).alias("rerun"))
    if policy == "bound":
        return check(rows, "_c").select(ENTITY, TIME, F.coalesce("_c", F.lit(default)).alias("state"), F.col("_c").isNull().alias("open"), F.lit(False).alias("rerun"))
    if policy != "rerun" or exact is None:
        raise Unsupported(f"policy {policy}", "not plain, bound, or rerun with an exact plan")
    state, done = rows.withColumn("rerun", F.lit(False)), []
    new = F.col("_c").isNull() & ~F.col("rerun")
    while True:
        judged = save(check(state, "_c").withColumn("_on", F.bool_or(new).over(W.partitionBy(ENTITY))), "judged")
        done.append(judged.filter("NOT _on").drop("_on"))
        again = judged.filter("_on")
        asked = again.filter(new).select(ENTITY, TIME)
        if asked.isEmpty():
            break
        got = exact(asked).select(ENTITY, TIME, F.col("value").alias("_x"))
        pick = lambda c: F.when(new, F.col("_x")).otherwise(F.col(c)).alias(c)
        state = again.join(got, [ENTITY, TIME], "left").select(ENTITY, TIME, *[pick(c) for c in ANSWER[2:]], (F.col("rerun") | new).alias("rerun"))
    whole = done[0]
    for d in done[1:]:
        whole = whole.union(d)
    still = whole.filter("_c IS NULL")
    if still.isEmpty():
        return whole.select(ENTITY, TIME, F.col("_c").alias("state"), F.lit(False).alias("open"), "rerun")
    keys = whole.join(still.select(ENTITY).distinct(), ENTITY, "left_semi").select(ENTITY, TIME)
    truth = check(_bare(keys.join(exact(keys), [ENTITY, TIME], "left")), "_x").select(ENTITY, TIME, "_x")
    both = whole.join(truth, [ENTITY, TIME], "left")
    return both.select(ENTITY, TIME, F.coalesce("_c", "_x", F.lit(default)).alias("state"), F.col("_c").isNull().alias("open"), "rerun")


def summary(judged: DataFrame, exact_states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, evaluations, reruns, open, agreement) of a judged arm with the exact arm's (entity, t, state)."""
    both = judged.join(exact_states.select(ENTITY, TIME, F.col("state").alias("_e")), [ENTITY, TIME], "left")
    same = F.col("state") == F.coalesce("_e", F.lit(False))
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("evaluations"), F.count_if("rerun").alias("reruns"), F.count_if("open").alias("open"), F.avg(same.cast("double")).alias("agreement"))
