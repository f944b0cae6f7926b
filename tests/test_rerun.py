"""Checks over intervals against plain loops; the rerun policy's rounds, what it asks, and nulls."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallywell.model import Unsupported
from tallywell.operators import rerun as N
from tallywell.operators import rules as R

SCHEMA = "entity string, t long, value double, low double, high double"


def answers(seed=4, n=90):
    r = random.Random(seed)
    out = []
    for e in ("a", "b", "c", "d"):
        for t in range(n):
            v = None if e == "b" and r.random() < 0.1 else round(100 + r.gauss(0, 8) + (15 if t > 60 and e != "c" else 0), 3)
            wide = 0.0 if e == "d" else r.choice([0.0, 2.0, 6.0])
            out.append((e, t, v, None if v is None else v - wide, None if v is None else v + wide))
    return out


def truth(rows, seed=9):
    r = random.Random(seed)
    return {(e, t): None if v is None or r.random() < 0.02 else round(r.uniform(lo, hi), 3) for e, t, v, lo, hi in rows}


def gt(lo, hi, x):
    return False if lo is None else True if lo > x else False if hi <= x else None


def plain_band(own, size=6, k=0.8):
    out = []
    for i, (_, lo, hi) in enumerate(own):
        past = [v for v, _, _ in own[max(0, i - size) : i] if v is not None]
        if len(past) < size:
            out.append(False)
            continue
        m = sum(past) / len(past)
        out.append(gt(lo, hi, m + k * math.sqrt(sum((v - m) ** 2 for v in past) / len(past))))
    return out


def plain_cusum(own, training=20, k=0.25, h=3):
    first = [v for v, _, _ in own[:training] if v is not None]
    if len(first) < training:
        return [False] * len(own)
    m = sum(first) / training
    sd = math.sqrt(sum((v - m) ** 2 for v in first) / training)
    out, low, high = [], 0.0, 0.0
    for i, (v, lo, hi) in enumerate(own):
        if i < training or v is None:
            out.append(False)
            continue
        low, high = (min(2 * h * sd, max(0.0, s + x - m - k * sd)) for s, x in ((low, lo), (high, hi)))
        out.append(True if low > h * sd else False if high <= h * sd else None)
    return out


def plain_judge(rows, exact, check):
    """Rounds of all open evaluations together, as stated."""
    out = {}
    for e in sorted({x[0] for x in rows}):
        own = [list(x[2:]) for x in sorted(rows, key=lambda x: x[:2]) if x[0] == e]
        again = set()
        while True:
            c = check(own)
            new = [i for i, x in enumerate(c) if x is None and i not in again]
            if not new:
                break
            for i in new:
                again.add(i)
                own[i] = [exact[(e, i)]] * 3
        last = check([[exact[(e, i)]] * 3 for i in range(len(own))])
        for i, x in enumerate(c):
            out[(e, i)] = (last[i] if x is None else x, x is None, i in again)
    return out


@pytest.mark.parametrize("check, plain", [(N.band(6, 0.8), plain_band), (N.cusum(20, 0.25, 3), plain_cusum)])
def test_rerun_equals_plain_rounds(spark, check, plain):
    rows = answers()
    exact = truth(rows)
    table = spark.createDataFrame([(e, t, v) for (e, t), v in exact.items()], "entity string, t long, value double")
    asked = []

    def answer(keys):
        asked.append({tuple(r) for r in keys.collect()})
        return table.join(keys, ["entity", "t"], "left_semi")

    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.entity, r.t): (r.state, r.open, r.rerun) for r in N.judge(df, check, "rerun", answer).collect()}
    want = plain_judge(rows, exact, plain)
    assert got == want
    reran = {k for k, v in want.items() if v[2]}
    assert reran and not any(e == "d" for e, _ in reran)
    stuck = any(v[1] for v in want.values())
    rounds = asked[:-1] if stuck else asked
    assert len(rounds) > (plain is plain_band) and set().union(*rounds) == reran and sum(map(len, rounds)) == len(reran)


def test_bound_and_plain(spark):
    df = spark.createDataFrame([("a", 1, 5.0, 4.0, 6.0), ("a", 2, 9.0, 8.0, 9.5), ("a", 3, None, None, None)], SCHEMA)
    states = lambda policy, **of: [(r.state, r.open) for r in N.judge(df, N.threshold(5), policy, **of).orderBy("t").collect()]
    assert states("plain") == [(False, False), (True, False), (False, False)]
    assert states("bound") == [(False, True), (True, False), (False, False)]
    assert states("bound", default=True) == [(True, True), (True, False), (False, False)]
    with pytest.raises(Unsupported):
        N.judge(df, N.threshold(5), "rerun")
    assert N.judge(df.filter("false"), N.band(3, 1), "rerun", lambda keys: df.select("entity", "t", "value")).count() == 0


def test_widened(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, -10.0), ("a", 3, None)], "entity string, t long, value double")
    ends = lambda *of: [(r.low, r.high) for r in N.widened(df, *of).orderBy("t").collect()]
    assert ends("relative", 0.25) == [(8.0, 10 / 0.75), (-10 / 0.75, -8.0), (None, None)]
    assert ends("relative", 1.0)[0] == (5.0, math.inf)
    assert ends("absolute", 2.0) == [(8.0, 12.0), (-12.0, -8.0), (None, None)]
    read = spark.createDataFrame([("a", 1, q, v) for q, v in zip(N.companion_ranks(0.9, 0.05), (7.0, 8.0, 7.5))] + [("b", 1, N.companion_ranks(0.9, 0.05)[1], 3.0)], "entity string, t long, q double, value double")
    got = {r.entity: (r.low, r.value, r.high) for r in N.widened(N.from_quantiles(read, 0.9, 0.05)[0], "rank", 0.05, N.from_quantiles(read, 0.9, 0.05)[1]).collect()}
    assert got == {"a": (7.0, 8.0, 8.0), "b": (3.0, 3.0, 3.0)}
    assert N.companion_ranks(0.99, 0.05)[2] == 1.0
    with pytest.raises(Unsupported):
        N.widened(df, "l2", 0.1)


def test_three_values(spark):
    df = spark.createDataFrame([(2.0, 1.0, 3.0, 2.0, 1.0, 4.0), (2.0, 1.0, 3.0, 0.5, 0.0, 1.0), (None, None, None, 1.0, 1.0, 1.0)], "a double, al double, ah double, b double, bl double, bh double")
    low, high = N.ratio((F.col("al"), F.col("ah")), (F.col("bl"), F.col("bh")))
    assert [tuple(r) for r in df.select(low, high).collect()] == [(0.25, 3.0), (-math.inf, math.inf), (None, None)]
    yes, no, open_ = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert tuple(spark.range(1).select(open_ | yes, open_ | no, open_ & no, open_ & yes).first()) == (True, None, False, None)


def test_folds_are_linear_and_whole(spark):
    """An entity of more evaluations than are folded together: CUSUM as the plain loop has it, every row there."""
    n = 1000
    r = random.Random(1)
    rows = [("a", t, r.gauss(0, 1) + (0.8 if 500 < t < 560 else 0)) for t in range(n)]
    df = spark.createDataFrame(rows, "entity string, t long, value double")
    got = [x.state for x in R.cusum(df, "value", "state", 50, 0.5, 4).orderBy("t").collect()]
    assert got == [bool(x) for x in plain_cusum([(v, v, v) for _, _, v in rows], 50, 0.5, 4)] and any(got) and len(got) == n
