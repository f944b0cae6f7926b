"""Panes in the state of a stream: several batches, a restart, late samples, and how much is held."""

import datetime

import pytest

from tallywell.plans import panes as P
from tallywell.streaming import ingest, stateful

BASE = 1_700_000_000_000
SCHEMA = "k string, ts_ms long, value double"
NAMES = ["window_end", "k", "n", "total", "least", "largest", "first_ms", "first", "last_ms", "last"]


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def start(spark, tmp_path, **of):
    s = ingest.stream_samples(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema)
    return stateful.keep_complete(s, str(tmp_path / "out"), str(tmp_path / "cp"), 50, ["k"], lateness_ms=100, **of)


def samples(a, b, k="s"):
    return [(k, BASE + 7 * i, float(i * 31 % 13)) for i in range(a, b)]


def test_panes_over_batches_and_a_restart(spark, tmp_path):
    put(spark, str(tmp_path / "in"), samples(0, 40) + samples(5, 30, "u") + [("s", None, 1.0), ("s", BASE + 3, None)])
    put(spark, str(tmp_path / "in"), samples(40, 80)[::-1])
    q = stateful.run_to_end(start(spark, tmp_path))
    held = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    early = stateful.complete(spark, str(tmp_path / "out"))
    n = early.count()
    put(spark, str(tmp_path / "in"), samples(80, 140) + samples(75, 79, "u"))
    q = stateful.run_to_end(start(spark, tmp_path))
    got = stateful.complete(spark, str(tmp_path / "out")).select(*NAMES)
    every = spark.createDataFrame(samples(0, 140) + samples(5, 30, "u") + samples(75, 79, "u"), SCHEMA)
    latest = BASE + 7 * 139
    want = P.build(every, 50, ["k"]).filter(f"window_end + 100 <= {latest}").select(*NAMES)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert 0 < n < got.count() and stateful.late(spark, str(tmp_path / "out")).count() == 0
    # a pane, its timer and the timer's index for each of at most lateness / width + 2 open panes of two series
    assert 0 < held <= 4 * 2 * 4 and q.lastProgress["stateOperators"][0]["numRowsTotal"] <= held + 8


def test_late_samples_have_their_table(spark, tmp_path):
    put(spark, str(tmp_path / "in"), samples(0, 60))
    stateful.run_to_end(start(spark, tmp_path, strict=False))
    put(spark, str(tmp_path / "in"), [("s", BASE + 1, 5.0), ("v", BASE + 2, 6.0), ("s", BASE + 7 * 59 + 1, 7.0)])
    stateful.run_to_end(start(spark, tmp_path, strict=False))
    assert sorted((r.k, r.ts_ms, r.value) for r in stateful.late(spark, str(tmp_path / "out")).collect()) == [("s", BASE + 1, 5.0), ("v", BASE + 2, 6.0)]
    first = stateful.complete(spark, str(tmp_path / "out")).filter(f"window_end <= {BASE + 50}").agg({"n": "sum"}).first()[0]
    assert first == sum(1 for _, t, _ in samples(0, 60) if t <= -(-BASE // 50) * 50 or (t - 1) // 50 * 50 + 50 <= BASE + 50)


def test_late_samples_stop_a_strict_stream(spark, tmp_path):
    put(spark, str(tmp_path / "in"), samples(0, 60))
    stateful.run_to_end(start(spark, tmp_path))
    n = stateful.complete(spark, str(tmp_path / "out")).count()
    put(spark, str(tmp_path / "in"), [("s", BASE + 1, 5.0)])
    for _ in range(2):
        with pytest.raises(Exception, match="late samples"):
            stateful.run_to_end(start(spark, tmp_path))
    assert stateful.complete(spark, str(tmp_path / "out")).count() == n


def test_samples_beyond_the_horizon_are_an_error(spark, tmp_path):
    put(spark, str(tmp_path / "in"), samples(0, 60))
    stateful.run_to_end(start(spark, tmp_path, horizon_ms=400))
    put(spark, str(tmp_path / "in"), [("s", BASE - 5000, 5.0)])
    with pytest.raises(ValueError, match="beyond the horizon"):
        stateful.run_to_end(start(spark, tmp_path, horizon_ms=400))
    with pytest.raises(ValueError, match="horizon"):
        start(spark, tmp_path, horizon_ms=100)


def test_labels_of_any_kind_come_back(spark, tmp_path):
    """Panes of many series lie in a few states, as tables; their labels are null, long, or hold quotes and commas."""
    schema = "a long, b string, c timestamp, ts_ms long, value double"
    labels = [((1 << 60) + i if i % 7 else None, ['x"y,z', "", None, "\\n"][i % 4], datetime.datetime(2024, 1, 1, microsecond=i) if i % 5 else None) for i in range(60)]
    rows = [(*x, BASE + 20 * j + i, float(i * j)) for i, x in enumerate(labels) for j in range(12)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = ingest.stream_samples(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    got = stateful.open_panes(s, 50, ["a", "b", "c"], lateness_ms=100, buckets=2)
    q = got.writeStream.format("memory").queryName("kinds").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    stateful.run_to_end(q)
    every = spark.createDataFrame(rows, schema)
    want = P.build(every, 50, ["a", "b", "c"]).filter(f"window_end + 100 <= {max(r[3] for r in rows)}")
    columns = ["a", "b", "c", *NAMES[:1], *NAMES[2:]]
    assert sorted(map(repr, spark.table("kinds").filter("kind = 'pane'").select(*columns).collect())) == sorted(map(repr, want.select(*columns).collect()))
    assert want.count() > 100 and q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
