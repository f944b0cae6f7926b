"""Run records, chunks of JSON lines, and the steps that must be linear or bounded."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywell.functions.hashing import integer_key
from tallywell.model import Unsupported
from tallywell.operators import exact as X
from tallywell.operators import rules as R
from tallywell.operators import scoring as C
from tallywell.operators import stream_sketches as S
from tallywell.operators import study as D
from tallywell.operators import trials as A
from tallywell.sources import chunks as K
from tallywell.sources import records as Z

GOOD = [(1, 5, "app_state", "r", {"e": "a"}, "state", None, "active", "state"), (1, 9, "fidelity_summary", "r", {}, "agreement", 0.5, None, "ratio")]


def test_a_run_replaces_itself_and_a_lost_one_is_not_seen(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame(GOOD, Z.SCHEMA)
    first = Z.write_run(rows, root, "r", "case")
    Z.write_run(spark.createDataFrame([(*GOOD[0][:3], "s", *GOOD[0][4:])], Z.SCHEMA), root, "s", "case")
    assert Z.read_runs(spark, root).count() == 3 and Z.read_runs(spark, root, ["r"]).count() == 2
    second = Z.write_run(rows.limit(1), root, "r", "case", json.dumps({"again": True}))
    assert first != second and [tuple(x)[:5] for x in Z.index(spark, root).orderBy("run_id").collect()] == [("r", "case", 5, 5, 1), ("s", "case", 5, 5, 1)]
    assert Z.read_runs(spark, root, ["r"]).count() == 1 and Z.read_runs(spark, root, kinds=["fidelity_summary"]).count() == 0
    rows.write.partitionBy("kind").parquet(f"{root}/rows/lost")  # an attempt that never got to the index
    assert Z.read_runs(spark, root).count() == 2 and Z.read_runs(spark, root, ["none"]).count() == 0
    got = Z.read_runs(spark, root, ["s"]).first()
    assert (got.labels, got.value_str, got.value_num, got.schema_version) == ({"e": "a"}, "active", None, 1)


@pytest.mark.parametrize("at, value, why", [(0, 2, "schema_version"), (1, None, "no time"), (2, "other", "kind"), (3, "x", "another run"), (4, {"e": None}, "label"), (5, "", "empty"), (6, 1.0, "number or else"), (7, None, "number or else"), (8, None, "empty")])
def test_what_is_no_record_is_refused(spark, tmp_path, at, value, why):
    bad = list(GOOD[0])
    bad[at] = value
    with pytest.raises(Exception, match=why):
        Z.write_run(spark.createDataFrame([tuple(bad), GOOD[1]], Z.SCHEMA), str(tmp_path), "r", "case")
    with pytest.raises(Exception):
        Z.index(spark, str(tmp_path)).count()


def test_record_columns_and_groups(spark, tmp_path):
    df = spark.createDataFrame([("a", 3, 1.5), ("b", 4, 2.5)], "e string, t long, v double")
    rows = df.select(*Z.record(F.col("t"), "query_result", "q", {"entity": F.col("e")}, "v", F.col("v"), "count"))
    Z.write_run(rows, str(tmp_path / "runs"), "q", "case")
    assert sorted((r.time, r.labels["entity"], r.value_num) for r in Z.read_runs(spark, str(tmp_path / "runs")).collect()) == [(3, "a", 1.5), (4, "b", 2.5)]
    with pytest.raises(Unsupported):
        Z.record(F.col("t"), "nope", "q", {}, "v", F.col("v"), "count")
    with pytest.raises(Unsupported):
        Z.write_run(rows.filter("false"), str(tmp_path / "runs"), "q", "case")
    Z.write_groups(df, str(tmp_path / "csv"), ["e"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).filter("e = 'b'").first().v == "2.5"


SAMPLE = T.StructType([T.StructField("k", T.StringType()), T.StructField("ts_ms", T.LongType()), T.StructField("value", T.DoubleType())])


def test_malformed_lines_have_numbers(spark, tmp_path):
    lines = [json.dumps({"k": "a", "ts_ms": i, "value": 1.0}) for i in range(3000)]
    lines[7], lines[2500], lines[2998], lines[5] = "{not json", '{"k": "x", "value": 1}', "[1, 2]", "   "
    (tmp_path / "a.json").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.json").write_text('{"k": null, "ts_ms": 1, "value": null}\nbad\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        bad = sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in K.malformed(spark, str(tmp_path), SAMPLE).collect())
        n = K.read_lines(spark, str(tmp_path), SAMPLE).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert bad == [("a.json", 8, "{not json"), ("a.json", 2501, '{"k": "x", "value": 1}'), ("a.json", 2999, "[1, 2]"), ("b.json", 2, "bad")]
    assert n == 3000 - 4 + 1


def test_chunks_are_handed_on_once(spark, tmp_path):
    rows = [("a", t, float(t)) for t in (1, 5, 10, 11, 29, 30, 31, 99)] + [("a", None, 1.0)]
    K.write_lines(spark.createDataFrame(rows, SAMPLE), str(tmp_path / "lines"))
    ends = [10, 20, 30]
    K.cut(K.read_lines(spark, str(tmp_path / "lines"), SAMPLE), ends, str(tmp_path / "cut"))
    seen, fail = [], {1}

    def refresh(part, i, end):
        if i in fail:
            fail.clear()
            raise RuntimeError("lost")
        seen.append((i, end, sorted(r.ts_ms for r in part.collect())))

    go = lambda: K.replay(spark, str(tmp_path / "cut"), SAMPLE, ends, str(tmp_path / "done"), refresh)
    with pytest.raises(RuntimeError):
        go()
    assert go() == 2 and go() == 0
    assert seen == [(0, 10, [1, 5, 10]), (1, 20, [11]), (2, 30, [29, 30])]
    with pytest.raises(Unsupported):
        K.cut(spark.createDataFrame(rows, SAMPLE), [3, 2], str(tmp_path / "x"))


def test_hip_is_that_of_the_whole_order(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(4000)) for i in range(9000)]
    df = spark.createDataFrame(rows, "i long, k long")
    key = integer_key(F.col("k"))
    got = [S.hll_hip(df.repartition(n, "k" if n == 5 else "i"), key, ["i"], 8).first()[0] for n in (1, 5, 7)]
    assert len({round(x, 6) for x in got}) == 1 and abs(got[0] / len({k for _, k in rows}) - 1) < 0.25


def test_matching_is_nearest_first_and_linear(spark):
    r = random.Random(5)
    n = 400
    acts = [[r.choice(["none", "none", "up", "down"]) for _ in range(n)] for _ in range(2)]
    df = spark.createDataFrame([(e, t, *((acts[0][t], acts[1][t]) if e == "a" else ("none", "up"))) for e in ("a", "b") for t in range(n)], "entity string, t long, exact string, approx string")
    pairs = sorted((abs(i - j), j, i) for i in range(n) for j in range(max(0, i - 2), min(n, i + 3)) if acts[0][i] != "none" and acts[0][i] == acts[1][j])
    left, right, want = set(), set(), set()
    for _, j, i in pairs:
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            want.add((acts[0][i], i, j))
    want |= {(acts[0][i], i, None) for i in range(n) if acts[0][i] != "none" and i not in left} | {(acts[1][j], None, j) for j in range(n) if acts[1][j] != "none" and j not in right}
    got = R.matched_actions(df).collect()
    assert {tuple(x)[1:] for x in got if x.entity == "a"} == want and sum(x.entity == "b" for x in got) == n


def test_action_summary_and_decision_pairs(spark):
    matched = spark.createDataFrame([("a", "up", 3, 4), ("a", "up", 9, 7), ("a", "up", None, 1), ("b", "down", 2, None)], "entity string, action string, exact_at int, approx_at int")
    assert sorted(tuple(r) for r in R.action_summary(matched).collect()) == [("down", 0, 1, 0, None, 0, 0), ("up", 2, 0, 1, -0.5, 1, 1)]
    e = spark.createDataFrame([("a", 1, "up"), ("a", 2, "none"), ("b", 1, "up")], "entity string, t long, decision string")
    q = spark.createDataFrame([("a", 1, "up"), ("a", 2, "down"), ("c", 1, "down")], "entity string, t long, decision string")
    assert sorted(tuple(r) for r in R.decision_pairs(e, q).collect()) == [("none", "down", 2), ("up", "none", 1), ("up", "up", 1)]


def test_ranks_of_a_narrow_range(spark):
    """Values that lie within a thousandth of their size; nulls, NaN and infinities beside them."""
    base = 1_700_000_000_000
    values = [float(base + i * i % 99991) for i in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values] + [(float("inf"),), (float("-inf"),), (None,), (float("nan"),)], "v double")
    order = sorted([*values, float("inf"), float("-inf")]) + [float("nan")]
    for q in (0.0, 0.1, 0.5, 0.999):
        assert X.quantiles(df, "v", [q], "floor").first().value == order[min(int(q * len(order)), len(order) - 1)]


@pytest.mark.parametrize("rule", ["linear", "order", "floor"])
def test_hot_groups_are_cut(spark, monkeypatch, rule):
    """A group of more different values than one task sorts, beside small ones, a null one, and one of nulls."""
    r = random.Random(4)
    rows = [("hot", 1, r.gauss(0, 1)) for _ in range(900)] + [("hot", 1, 7.0)] * 50 + [("small", 1, float(i)) for i in range(9)] + [(None, 2, float(i % 40)) for i in range(200)] + [("nulls", 1, None), ("hot", None, 3.0)]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(4)
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = lambda: sorted(((x.g or "", x.h or 0, x.q, x.value) for x in X.quantiles(df, "v", qs, rule, ["g", "h"]).collect()))
    want = got()
    assert len(want) == 4 * len(qs)
    monkeypatch.setattr(X, "HOT_VALUES", 20)
    assert got() == want


def test_too_many_answers_are_refused(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST_ANSWERS", 2)
    df = spark.createDataFrame([(1.0,)], "v double")
    answers = spark.createDataFrame([(q / 10, 1.0) for q in range(3)], "q double, value double")
    with pytest.raises(Unsupported):
        C.rank_errors(df, "v", answers)
    assert C.rank_errors(df.withColumn("g", F.lit("a")), "v", answers.withColumn("g", F.lit("a")), ["g"]).count() == 3


def test_constrained_fit(spark):
    rows = [(s, float(x), 1.0, float(-x), 5.0 * x + 10) for s in ("a", "b", "c") for x in range(1, 6)] + [("d", None, 1.0, 0.0, 3.0), ("d", 1.0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "s string, x double, one double, down double, y double")
    fits = {r.left_out: r for r in D.constrained_fit(df, "s", ["x", "one", "down"], "y").collect()}
    assert set(fits) == {None, "a", "b", "c"} and {r.points for r in fits.values()} == {15, 10}
    for r in fits.values():
        assert [round(c, 6) for c in r.coefficients] == [5.0, 10.0, 0.0] and r.worst < 1e-9
    falling = spark.createDataFrame([("a", 1.0, 1.0, 9.0), ("a", 2.0, 1.0, 5.0), ("b", 3.0, 1.0, 2.0)], "s string, x double, one double, y double")
    assert all(min(r.coefficients) >= 0 for r in D.constrained_fit(falling, "s", ["x", "one"], "y").collect())
    assert D.constrained_fit(df.filter("false"), "s", ["x"], "y").count() == 0
    with pytest.raises(Unsupported):
        D.constrained_fit(df, "s", [], "y")


def test_rank_agreement(spark):
    df = spark.createDataFrame([("g", x, y) for x, y in zip((1, 2, 3, 4, 4), (1, 3, 2, 4, 5))] + [("h", 1, 1), ("h", 1, 2), ("g", None, 3)], "g string, x int, y int")
    got = {r.g: (r.n, r.tau and round(r.tau, 9)) for r in D.rank_agreement(df, ["g"], "x", "y").collect()}
    assert got == {"g": (5, round(7 / (9 * 10) ** 0.5, 9)), "h": (2, None)}


def test_trials_differ_and_repeat(spark):
    counts = spark.createDataFrame([(i, 1 + i % 7) for i in range(600)], "k long, n long")
    for mode in ("relabel", "reseed"):
        e = {r.trial: r.error for r in A.frequency_errors(counts, F.col("k"), "n", 6, mode, 2, 64).collect()}
        assert len(e) == 6 and len({round(x, 9) for x in e.values()}) > 3 and all(x > 0 for x in e.values())
        assert e == {r.trial: r.error for r in A.frequency_errors(counts.repartition(3), F.col("k"), "n", 6, mode, 2, 64).collect()}
        c = [r.error for r in A.cardinality_errors(counts, F.col("k"), 6, mode, 8).collect()]
        assert len(c) == 6 and max(c) < 0.35
    with pytest.raises(Unsupported):
        A.drawn_again(counts, F.col("k"), 2, "both")


def test_folds_take_linear_time(spark):
    def took(n: int) -> float:
        df = spark.range(n).select(F.lit("a").alias("entity"), F.col("id").alias("t"), (F.col("id") * 31 % 101).cast("double").alias("value"))
        t = time.perf_counter()
        assert R.above_decayed_band(df, "value", "state", 0.99, 2, 10).filter("state").count() >= 0
        return time.perf_counter() - t

    took(2_000)
    # twice the rows take twice the time and not four times; a busy machine gets three tries
    assert any(took(40_000) < 3 * took(20_000) for _ in range(3))
