"""Stored panes: what a second run reads, runs that are lost half-way, eviction, incomplete panes, and views of views."""

import random

import pytest

from tallywell.model import Unsupported
from tallywell.operators import windows as V
from tallywell.plans import panes as P
from tallywell.plans import views as U

LABELS = ("k", "u")


@pytest.fixture(scope="module")
def samples(spark):
    r = random.Random(3)
    rows = [(r.choice("xyz"), r.randint(0, 3), r.randint(1, 1000), float(r.randint(0, 50))) for _ in range(800)]
    rows = list({x[:3]: x for x in rows}.values())
    return spark.createDataFrame(rows, "k string, u long, ts_ms long, value double").cache()


def direct(samples, grid, range_ms):
    return sorted(map(tuple, V.over_time(samples, grid, range_ms, "sum", LABELS).collect()))


def sums(state, labels=LABELS):
    return sorted((r.t, *[r[x] for x in labels], r.total) for r in state.collect())


def test_the_second_run_reads_what_is_new(spark, samples, tmp_path):
    store, view = U.Store(spark, str(tmp_path)), U.View(50, LABELS)
    got, cost = store.merged(view, samples, V.Grid(200, 400, 100), 200, retention_ms=5000)
    assert sums(got) == direct(samples, V.Grid(200, 400, 100), 200)
    assert (cost.panes_built, cost.panes_reused, cost.samples_read) == (8, 0, samples.filter("ts_ms <= 400").count())
    grid = V.Grid(200, 600, 100)
    got, cost = U.Store(spark, str(tmp_path)).merged(view, samples, grid, 200, retention_ms=5000)
    assert sums(got) == direct(samples, grid, 200)
    assert (cost.panes_built, cost.panes_reused, cost.samples_read) == (4, 8, samples.filter("ts_ms > 400 AND ts_ms <= 600").count())
    rate = lambda df: sorted((r.t, r.k, r.u, round(r.value, 9)) for r in df.collect())
    assert rate(P.increase_of(got, 200, LABELS)) == rate(V.increase_over(samples, grid, 200, LABELS))
    assert cost.state_rows > 0 and cost.state_bytes > 0
    got, cost = store.merged(view, samples, grid, 200, retention_ms=5000)
    assert (cost.views_refreshed, cost.samples_read) == (0, 0) and sums(got) == direct(samples, grid, 200)


def test_a_lost_run_leaves_nothing_that_is_read(spark, samples, tmp_path):
    store, view, grid = U.Store(spark, str(tmp_path)), U.View(50, LABELS), V.Grid(200, 400, 100)
    wrong = P.build(samples.filter("ts_ms <= 100"), 50, LABELS).union(P.build(samples.limit(1), 50, LABELS)).withColumnRenamed("window_end", "pane").selectExpr("pane", "k", "u", *[c if c != "total" else "total + 1000 AS total" for c in P.STATE])
    wrong.write.mode("overwrite").partitionBy("pane").parquet(f"{tmp_path}/{view.key}")
    got, cost = store.merged(view, samples, grid, 200)
    assert cost.panes_reused == 0 and sums(got) == direct(samples, grid, 200)


def test_eviction(spark, samples, tmp_path):
    store, view = U.Store(spark, str(tmp_path)), U.View(50, LABELS)
    _, cost = store.merged(view, samples, V.Grid(400, 400, 100), 200)
    assert cost.panes_evicted == 0 and store.held(view, 0, 1000) == [250, 300, 350, 400]
    _, cost = store.merged(view, samples, V.Grid(500, 500, 100), 200)
    assert cost.panes_evicted == 2 and store.held(view, 0, 1000) == [350, 400, 450, 500]
    import os

    assert sorted(x for x in os.listdir(f"{tmp_path}/{view.key}") if x.startswith("pane=")) == [f"pane={e}" for e in (350, 400, 450, 500)]
    got, cost = store.merged(view, samples, V.Grid(400, 500, 100), 200)
    assert cost.panes_built == 2 and sums(got) == direct(samples, V.Grid(400, 500, 100), 200)


def test_incomplete_panes_are_not_stored(spark, samples, tmp_path):
    store, view, grid = U.Store(spark, str(tmp_path)), U.View(50, LABELS), V.Grid(200, 500, 100)
    now = samples.filter("ts_ms <= 430")
    got, cost = store.merged(view, now, grid, 200, complete_to=430, retention_ms=5000)
    assert sums(got) == direct(now, grid, 200) and max(store.held(view, 0, 1000)) == 400
    assert cost.samples_at_query == now.filter("ts_ms > 400").count()
    got, cost = store.merged(view, samples, grid, 200, complete_to=500, retention_ms=5000)
    assert sums(got) == direct(samples, grid, 200) and cost.samples_read == samples.filter("ts_ms > 400 AND ts_ms <= 500").count()


def test_views_of_views_and_empty_stretches(spark, samples, tmp_path):
    store = U.Store(spark, str(tmp_path))
    base = U.View(50, LABELS)
    wide, few = U.View(100, LABELS, source=base), U.View(100, ("k",), source=base)
    grid = V.Grid(200, 600, 100)
    got, cost = store.merged(wide, samples, grid, 200, retention_ms=5000)
    assert sums(got) == direct(samples, grid, 200) and cost.panes_built == 12 + 6
    got, cost = store.merged(few, samples, grid, 200, retention_ms=5000)
    assert cost.samples_read == 0 and sums(got, ("k",)) == sorted(map(tuple, V.over_time(samples, grid, 200, "sum", ["k"]).collect()))
    got, cost = store.merged(base, samples, V.Grid(3000, 3000, 100), 200)
    assert got.count() == 0 and (cost.panes_built, cost.samples_read) == (4, 0)
    with pytest.raises(Unsupported):
        U.View(70, LABELS, source=base)
    with pytest.raises(Unsupported):
        store.merged(base, samples, V.Grid(210, 410, 100), 200)


def test_sharing(spark, samples, tmp_path):
    a = U.Over("a", "rate", 600, 200, LABELS, by=("k",))
    b = U.Over("b", "avg", 400, 300, LABELS)
    c = U.Over("c", "max", 400, 100, LABELS, (("k", "x"),))
    plans = U.share([a, b, c])
    assert [(p.view.width, p.together, len(p.queries)) for p in plans] == [(100, 600, 2), (100, 100, 1)]
    assert {r.query: r.shared_by for r in U.report(spark, plans).collect()} == {"a": 2, "b": 2, "c": 1}
    store, grid = U.Store(spark, str(tmp_path)), V.Grid(600, 1200, 300)
    got, first = U.answer(store, plans[0], a, samples, grid)
    want = V.aggregate(V.increase_over(samples, grid, 600, LABELS, True), "sum", ["k"])
    near = lambda df: sorted((r.t, r.k, round(r.value, 9)) for r in df.collect())
    assert near(got) == near(want)
    got, second = U.answer(store, plans[0], b, samples, grid)
    want = V.over_time(samples, grid, 400, "avg", LABELS)
    assert near(got) == near(want) and second.samples_read == 0 < first.samples_read
    got, _ = U.answer(store, plans[1], c, samples, grid)
    assert near(got) == near(V.over_time(samples.filter("k = 'x'"), grid, 400, "max", LABELS))
    with pytest.raises(Unsupported):
        U.answer(store, plans[0], U.Over("d", "entropy", 400, 100, LABELS), samples, grid)
