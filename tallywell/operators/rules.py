"""Decision rules over evaluations (entity, t, values...), and how two arms' decisions agree.

A condition is a boolean column over an entity's evaluations in time order; a
hold turns conditions into states. Most of both are window functions, so the
data may be spread by entity. Those that carry a state from one evaluation to the
next (CUSUM, a latch that isn't extended, the choice of matches) fold an array of
each entity's evaluations, whose number is set by the evaluation grid and not by
the data, in one expression.

A missing value never meets a condition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import bounded, save

ENTITY, TIME = "entity", "t"


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _past(size: int):
    return W.partitionBy(ENTITY).orderBy(TIME).rowsBetween(-size, -1)


def history(value: str, size: int, minimum: int | None = None) -> tuple[Column, Column]:
    """Mean and population deviation of the known values among the last ``size`` evaluations, this one left out; null below ``minimum``."""
    w, enough = _past(size), F.count(value).over(_past(size)) >= (minimum or size)
    return F.when(enough, F.avg(value).over(w)), F.when(enough, F.stddev_pop(value).over(w))


def above_band(value: str, size: int, k: float, minimum: int | None = None) -> Column:
    centre, spread = history(value, size, minimum)
    return _true(F.col(value) > centre + k * spread)


def outside_band(value: str, size: int, k: float, minimum: int | None = None) -> Column:
    centre, spread = history(value, size, minimum)
    return _true((F.col(value) > centre + k * spread) | (F.col(value) < centre - k * spread))


def above_mean_times(value: str, size: int, factor: float, minimum: int | None = None) -> Column:
    return _true(F.col(value) > factor * history(value, size, minimum)[0])


def above(value: str, threshold: float) -> Column:
    return _true(F.col(value) > threshold)


def below(value: str, threshold: float) -> Column:
    return _true(F.col(value) < threshold)


def at_least(value: str, threshold: float) -> Column:
    return _true(F.col(value) >= threshold)


def for_consecutive(flag: str, n: int) -> Column:
    """The flag has held for n evaluations in a row."""
    w = W.partitionBy(ENTITY).orderBy(TIME).rowsBetween(-(n - 1), 0)
    return F.sum(F.col(flag).cast("int")).over(w) >= n


def x_of_last_y(flag: str, x: int, y: int) -> Column:
    w = W.partitionBy(ENTITY).orderBy(TIME).rowsBetween(-(y - 1), 0)
    return F.sum(F.col(flag).cast("int")).over(w) >= x


#: Evaluations that are folded together: appending to a list copies it, so lists are kept this short and then joined.
_FOLD = 128


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def carried(df: DataFrame, out: str, start: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]], unknown: bool = False) -> DataFrame:
    """df with a boolean column that depends on what came before.

    start: the state before an entity's first evaluation. step(state, row): the
    state after a row, and the row's flag, whose null is false unless ``unknown``.
    The time is linear in an entity's evaluations.
    """
    rest = [c for c in df.columns if c not in (ENTITY, TIME)]
    in_order = F.array_sort(F.collect_list(F.struct(TIME, *rest))).alias("_rows")
    none = F.array().cast("array<boolean>")

    def one(acc: Column, row: Column) -> Column:
        state, flag = step(acc, row)
        return F.struct(*[state[k].alias(k) for k in start], F.concat(acc["_flags"], F.array(flag if unknown else _true(flag))).alias("_flags"))

    def some(acc: Column, rows: Column) -> Column:
        zero = F.struct(*[acc[k].alias(k) for k in start], none.alias("_flags"))
        return _once(F.aggregate(rows, zero, one), lambda got: F.struct(*[got[k].alias(k) for k in start], F.concat(acc["_all"], F.array(got["_flags"])).alias("_all")))

    parts = F.transform(F.sequence(F.lit(0), F.expr(f"(size(_rows) - 1) div {_FOLD}")), lambda i: F.slice("_rows", (i * _FOLD + 1).cast("int"), F.lit(_FOLD)))
    zero = F.struct(*[v.alias(k) for k, v in start.items()], F.array().cast("array<array<boolean>>").alias("_all"))
    rows = df.groupBy(ENTITY).agg(in_order).withColumn("_flags", F.flatten(F.aggregate(parts, zero, some, lambda acc: acc["_all"])))
    rows = rows.select(ENTITY, F.explode(F.arrays_zip("_rows", "_flags")).alias("_x"))
    return rows.select(ENTITY, "_x._rows.*", F.col("_x._flags").alias(out)).select(*df.columns, out)


def cusum(df: DataFrame, value: str, out: str, training: int, k: float, h: float) -> DataFrame:
    """The one-sided cumulative sum of what exceeds mean + k sd, at most 2 h sd; holds while it is above h sd.

    Mean and population deviation are of the first ``training`` evaluations, all
    of which must be known; they never hold, and neither do missing values, which
    leave the sum as it is.
    """
    known = F.when(~F.isnan(F.col(value)), F.col(value))
    rows = df.withColumn("_v", known).withColumn("_i", F.row_number().over(W.partitionBy(ENTITY).orderBy(TIME)))
    first, of = F.when(F.col("_i") <= training, F.col("_v")), W.partitionBy(ENTITY)
    enough = F.count(first).over(of) == training
    rows = rows.withColumn("_mean", F.when(enough, F.avg(first).over(of))).withColumn("_sd", F.when(enough, F.stddev_pop(first).over(of)))

    def step(state: Column, row: Column) -> tuple[dict[str, Column], Column]:
        excess = state["sum"] + row["_v"] - row["_mean"] - k * row["_sd"]
        now = F.when((row["_i"] > training) & excess.isNotNull(), F.least(2 * h * row["_sd"], F.greatest(F.lit(0.0), excess))).otherwise(state["sum"])
        return {"sum": now}, excess.isNotNull() & (row["_i"] > training) & (now > h * row["_sd"])

    return carried(rows, out, {"sum": F.lit(0.0)}, step).drop("_v", "_i", "_mean", "_sd")


def above_decayed_band(df: DataFrame, value: str, out: str, decay: float, k: float, minimum: int) -> DataFrame:
    """Above a baseline in which each known evaluation weighs ``decay`` times the next one, plus k such deviations; at
    least ``minimum`` of them must be known. The weighted sums of the values before are carried along, so no weight
    outgrows a double however long the history or small the decay."""

    def step(state: Column, row: Column) -> tuple[dict[str, Column], Column]:
        v, n = row["_v"], state["total"]
        centre = F.try_divide(state["first"], n)
        spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(state["second"], n) - centre * centre))
        kept = lambda name, x: F.when(v.isNull(), state[name]).otherwise(decay * state[name] + x)
        after = {"total": kept("total", F.lit(1.0)), "first": kept("first", v), "second": kept("second", v * v), "known": state["known"] + F.when(v.isNull(), 0).otherwise(1)}
        return after, (state["known"] >= minimum) & (v > centre + k * spread)

    rows = df.withColumn("_v", F.when(~F.isnan(F.col(value)), F.col(value)).cast("double"))
    zero = {name: F.lit(0.0) for name in ("total", "first", "second")}
    return carried(rows, out, {**zero, "known": F.lit(0)}, step).drop("_v")


def latch(df: DataFrame, flag: str, out: str, evaluations: int, extend: bool = True, while_held: bool = False) -> DataFrame:
    """On for ``evaluations`` from a hit on, that one included.

    extend: a hit while on counts anew, so it is on wherever one of the last
    ``evaluations`` was a hit. Otherwise a hit counts only when it is off; with
    ``while_held`` it then stays on as long as the condition holds on without a break.
    """
    if extend:
        recent = W.partitionBy(ENTITY).orderBy(TIME).rowsBetween(1 - evaluations, 0)
        return df.withColumn(out, _true(F.bool_or(F.col(flag)).over(recent)))

    def step(state: Column, row: Column) -> tuple[dict[str, Column], Column]:
        hit = _true(row[flag])
        running = state["left"] > 0
        held = state["on"] & hit if while_held else F.lit(False)
        on = running | held | hit
        left = F.when(running, state["left"] - 1).when(held, 0).when(hit, evaluations - 1).otherwise(0)
        return {"left": left, "on": on}, on

    return carried(df, out, {"left": F.lit(0), "on": F.lit(False)}, step)


# -- agreement of two arms -----------------------------------------------------------------------------------------


def spine(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """Every entity of either arm at every time of either, with exact and approx states; absent is off.

    The result is entities by evaluation times by definition. The times are written, and broadcast if they are few.
    """
    both = exact.select(ENTITY, TIME).union(approx.select(ENTITY, TIME))
    grid = both.select(ENTITY).distinct().crossJoin(bounded(save(both.select(TIME).distinct(), "times")))
    e, a = exact.select(ENTITY, TIME, F.col("state").alias("exact")), approx.select(ENTITY, TIME, F.col("state").alias("approx"))
    return grid.join(e, [ENTITY, TIME], "left").join(a, [ENTITY, TIME], "left").select(ENTITY, TIME, _true(F.col("exact")).alias("exact"), _true(F.col("approx")).alias("approx"))


def confusion(states: DataFrame) -> DataFrame:
    e, a = F.col("exact"), F.col("approx")
    tp, fp, fn, tn = F.count_if(e & a), F.count_if(~e & a), F.count_if(e & ~a), F.count_if(~e & ~a)
    return states.agg(
        tp.alias("true_positive"), fp.alias("false_positive"), fn.alias("false_negative"), tn.alias("true_negative"), ((tp + tn) / F.count(F.lit(1))).alias("agreement"),
        F.when(tp + fp + fn > 0, tp / (tp + fp + fn)).otherwise(1.0).alias("active_agreement"), F.countDistinct(ENTITY).alias("entities"),
    )


def _islands(df: DataFrame, flag: Column, name: str) -> DataFrame:
    """df with ``name``: the number of the run of equal flags that a row is in."""
    w = W.partitionBy(ENTITY).orderBy(TIME)
    turn = F.when(flag == F.lag(flag).over(w), 0).otherwise(1)
    return df.withColumn("_turn", turn).withColumn(name, F.sum("_turn").over(w)).drop("_turn")


def episodes(states: DataFrame) -> DataFrame:
    """(entity, start, end, evaluations, onset_delay, gaps) for each stretch where the exact arm is on.

    onset_delay: evaluations until the approximate arm is on, null if it misses the
    episode; gaps: stretches after that where it is off. Also useful as spans.
    """
    w = W.partitionBy(ENTITY).orderBy(TIME)
    s = _islands(states.withColumn("i", F.row_number().over(w)), F.col("exact"), "run").filter("exact")
    within = W.partitionBy(ENTITY, "run")
    s = s.withColumn("onset", F.min(F.when(F.col("approx"), F.col("i"))).over(within))
    off = ~F.col("approx") & (F.col("i") > F.col("onset"))
    starts = off & F.coalesce(F.lag("approx").over(within.orderBy("i")), F.lit(True))
    s = s.withColumn("gap", starts)
    return s.groupBy(ENTITY, "run").agg(F.min(TIME).alias("start"), F.max(TIME).alias("end"), F.count(F.lit(1)).alias("evaluations"), (F.min("onset") - F.min("i")).alias("onset_delay"), F.count_if("gap").alias("gaps")).drop("run")


def false_spans(states: DataFrame) -> DataFrame:
    """(entity, start, end, evaluations) for each stretch where only the approximate arm is on."""
    only = F.col("approx") & ~F.col("exact")
    return _islands(states, only, "run").filter(only).groupBy(ENTITY, "run").agg(F.min(TIME).alias("start"), F.max(TIME).alias("end"), F.count(F.lit(1)).alias("evaluations")).drop("run")


def top_set_fidelity(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """(t, overlap, exact_only, approx_only, identical) of two membership tables (entity, t)."""
    both = exact.select(ENTITY, TIME, F.lit(True).alias("e")).join(approx.select(ENTITY, TIME, F.lit(True).alias("a")), [ENTITY, TIME], "full")
    e, a = F.col("e").isNotNull(), F.col("a").isNotNull()
    return both.groupBy(TIME).agg(F.count_if(e & a).alias("overlap"), F.count_if(e & ~a).alias("exact_only"), F.count_if(a & ~e).alias("approx_only"), F.bool_and(e & a).alias("identical"))


# -- decisions -----------------------------------------------------------------------------------------------------


def scale(cpu: str, memory: str, cpu_up: float, memory_up: float, cpu_down: float, memory_down: float) -> Column:
    """up, down or none."""
    return F.when(above(cpu, cpu_up) | above(memory, memory_up), "up").when(below(cpu, cpu_down) & below(memory, memory_down), "down").otherwise("none")


def actions(decision: str) -> Column:
    """A decision that isn't none and differs from the one before; the first evaluation takes no action."""
    before = F.lag(decision).over(W.partitionBy(ENTITY).orderBy(TIME))
    return F.when((F.col(decision) != "none") & (before != F.col(decision)), F.col(decision)).otherwise("none")


def matched_actions(acted: DataFrame, window: int = 2) -> DataFrame:
    """acted(entity, t, exact, approx actions) -> (entity, action, exact_at, approx_at): pairs of equal actions at most
    ``window`` evaluations apart, nearest first, then earliest; and what is left alone on either side, with a null.

    Gap by gap, the actions that are still free on both sides and so far apart are
    candidates; an entity's candidates of one gap, in order of preference, are
    folded to those whose two ends are free. Of what was taken, only the last
    few can meet a candidate, so the time is linear in an entity's evaluations. What each gap took is written.
    """
    rows = acted.withColumn("i", F.row_number().over(W.partitionBy(ENTITY).orderBy(TIME)) - 1)
    exact = rows.filter("exact != 'none'").select(ENTITY, F.col("exact").alias("action"), F.col("i").alias("exact_at"))
    approx = rows.filter("approx != 'none'").select(ENTITY, F.col("approx").alias("action"), F.col("i").alias("approx_at"))
    pair, chosen = [ENTITY, "action", "exact_at", "approx_at"], None

    def step(state: Column, row: Column) -> tuple[dict[str, Column], Column]:
        took = (row["approx_at"] != state["approx"]) & ~F.array_contains(state["recent"], row["exact_at"])
        recent = F.slice(F.concat(F.array(row["exact_at"]), state["recent"]), 1, 2 * window + 2)
        return {"approx": F.when(took, row["approx_at"]).otherwise(state["approx"]), "recent": F.when(took, recent).otherwise(state["recent"])}, took

    for gap in range(window + 1):
        e = exact if chosen is None else exact.join(chosen, [ENTITY, "exact_at"], "left_anti")
        q = approx if chosen is None else approx.join(chosen, [ENTITY, "approx_at"], "left_anti")
        at = F.array_distinct(F.array(F.col("exact_at") - gap, F.col("exact_at") + gap))
        near = e.withColumn("approx_at", F.explode(at)).join(q, [ENTITY, "action", "approx_at"])
        order = F.col("approx_at").cast("long") * (2 * window + 1) + F.col("exact_at") - F.col("approx_at") + window
        took = carried(near.select(*pair, order.alias(TIME)), "took", {"approx": F.lit(-1), "recent": F.array().cast("array<int>")}, step).filter("took").select(*pair)
        took = save(took, "matched")
        chosen = took if chosen is None else chosen.union(took)
    only_exact = exact.join(chosen, [ENTITY, "exact_at"], "left_anti").select(ENTITY, "action", "exact_at", F.lit(None).cast("int").alias("approx_at"))
    only_approx = approx.join(chosen, [ENTITY, "approx_at"], "left_anti").select(ENTITY, "action", F.lit(None).cast("int").alias("exact_at"), "approx_at")
    return chosen.union(only_exact).union(only_approx)


def action_summary(matched: DataFrame) -> DataFrame:
    """(action, true_positive, false_negative, false_positive, mean_delay, early, late) of matched_actions' pairs; delays are in
    evaluations from the exact action to the approximate one, null where none is matched."""
    both, delay = F.col("exact_at").isNotNull() & F.col("approx_at").isNotNull(), F.col("approx_at") - F.col("exact_at")
    return matched.groupBy("action").agg(
        F.count_if(both).alias("true_positive"), F.count_if(F.col("approx_at").isNull()).alias("false_negative"), F.count_if(F.col("exact_at").isNull()).alias("false_positive"),
        F.avg(delay).alias("mean_delay"), F.count_if(delay < 0).alias("early"), F.count_if(delay > 0).alias("late"),
    )


def decision_pairs(exact: DataFrame, approx: DataFrame, decision: str = "decision", none: str = "none") -> DataFrame:
    """(exact, approx, n): how often the arms decide what at the same evaluation; an arm without one there decides ``none``."""
    keys = [ENTITY, TIME]
    both = exact.select(*keys, F.col(decision).alias("exact")).join(approx.select(*keys, F.col(decision).alias("approx")), keys, "full")
    return both.groupBy(F.coalesce("exact", F.lit(none)).alias("exact"), F.coalesce("approx", F.lit(none)).alias("approx")).agg(F.count(F.lit(1)).alias("n"))


# -- error intervals -----------------------------------------------------------------------------------------------


def interval_gt(low: Column, high: Column, threshold: Column) -> Column:
    """True, false, or null where the interval leaves it open; a missing answer is false."""
    return F.when(low.isNull(), False).when(low > threshold, True).when(high <= threshold, False)


def interval_lt(low: Column, high: Column, threshold: Column) -> Column:
    return F.when(low.isNull(), False).when(high < threshold, True).when(low >= threshold, False)


def settle(check: Column, exact: Column, policy: str, default: bool = False) -> Column:
    """An open check takes the default under bound, the exact plan's under rerun."""
    return F.coalesce(check, exact if policy == "rerun" else F.lit(default))
