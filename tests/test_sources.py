"""Importers, generators and the stream of panes."""

import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywell.model import Unsupported
from tallywell.plans import panes as P
from tallywell.sources import generate as G
from tallywell.sources import importers as I
from tallywell.streaming import ingest


def test_csv(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("time,host,load\n1.5,a,3\n2,b,4\n3,a,5\n")
    df = I.read_csv(spark, str(tmp_path / "a.csv.gz"), ["host"], "load", "time", "s")
    assert sorted(map(tuple, I.within(df, 1_500_000_000, 3_000_000_000).collect())) == [("a", 1_500_000_000, 3.0), ("b", 2_000_000_000, 4.0)]
    assert sorted(r.ts_ms for r in I.as_samples(df, 1_000_000_000, 1001).collect()) == [501, 1001]
    with pytest.raises(Unsupported):
        I.within(df, 0, 10)
    with pytest.raises(Unsupported):
        I.read_csv(spark, str(tmp_path / "a.csv.gz"), ["nope"], "load", "time")
    (tmp_path / "b.csv").write_text("time,host,load\n1,a,NaN\n")
    with pytest.raises(Exception, match="finite"):
        I.read_csv(spark, str(tmp_path / "b.csv"), ["host"], "load", "time").collect()


def test_task_usage(spark, tmp_path):
    row = ["600000000", "900000000", "3418309", "0", "4155527081", "0.001562"] + ["0"] * 14
    (tmp_path / "t.csv").write_text(",".join(row) + "\n")
    r = I.read_task_usage(spark, str(tmp_path / "t.csv")).first()
    assert (r.job_id, r.start_ns, r.end_ns, r.value) == ("3418309", 600_000_000_000, 900_000_000_000, 0.001562)


def test_arrow(spark, tmp_path):
    import pyarrow as pa

    t = pa.table({"start": ["2024-01-01 00:00:00"], "freq": ["15T"], "target": [[[1.0, 2.0], [3.0, 4.0]]]})
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    got = sorted(map(tuple, I.read_arrow(spark, str(tmp_path / "x.arrow")).collect()))
    assert [(v, x) for v, _, x in got] == [(0, 1.0), (0, 2.0), (1, 3.0), (1, 4.0)]
    assert got[1][1] - got[0][1] == I.frequency_ns("15T") == 900_000_000_000
    with pytest.raises(Unsupported):
        I.frequency_ns("2W")


def test_generators(spark):
    i = F.col("id")
    t = G.table(spark, 20000, u=G.uniform(i, 3), x=G.normal(i, 4, 5, 2), z=G.zipf(i, 5, 100, 1.0), s=G.text(i, 4))
    r = t.agg(F.avg("u"), F.avg("x"), F.stddev("x"), F.min("z"), F.max("z"), F.countDistinct("s")).first()
    assert abs(r[0] - 0.5) < 0.01 and abs(r[1] - 5) < 0.1 and abs(r[2] - 2) < 0.1 and (r[3], r[4], r[5]) == (1, 100, 20000)
    share = t.filter("z = 1").count() / t.filter("z = 10").count()
    assert 7 < share < 14
    assert t.exceptAll(t.repartition(7)).count() == 0
    labels = spark.createDataFrame([(f"l{i}", float(i + 1)) for i in range(20)], "l string, w double")
    assert G.weighted_labels(labels, "w", 5).select("l").distinct().count() == 5
    assert [r[0] for r in spark.range(4).select(G.phased(F.col("id") * 10, [{"start_ms": 0, "end_ms": 20, "scale": 3, "ramp_ms": 20}])).collect()] == [1.0, 2.0, 3.0, 1.0]
    assert spark.range(1).select(G.whole(F.lit(1e30)), G.whole(F.lit(-3.9)), G.whole(F.lit(1e30), True)).first()[1] == -3


def test_stream_of_panes(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("ts_ms", T.LongType()), T.StructField("value", T.DoubleType())])
    rows = [("s", 7 * i, float(i * 31 % 13)) for i in range(1, 60)]
    for n in range(3):
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    all_rows = spark.createDataFrame(rows, schema)
    q = ingest.keep_panes(ingest.stream_samples(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp"), 50, ["k"])
    q.awaitTermination()
    kept = P.roll_up(ingest.read_panes(spark, str(tmp_path / "out")), 50, ["k"]).select("window_end", "n", "total", "first", "last", "dropped")
    want = P.build(all_rows, 50, ["k"]).select("window_end", "n", "total", "first", "last", "dropped")
    assert kept.exceptAll(want).count() == want.exceptAll(kept).count() == 0


def test_streaming_windows_are_right_closed(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("ts_ms", T.LongType()), T.StructField("value", T.DoubleType())])
    spark.createDataFrame([("s", 10 * i, 1.0) for i in range(1, 21)], schema).write.parquet(str(tmp_path / "in"))
    q = ingest.stream_counts(ingest.stream_samples(spark, str(tmp_path / "in"), schema), 50, ["k"]).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.window_end, r.n) for r in spark.table("counts").collect()) == [(50, 5), (100, 5), (150, 5), (200, 5)]
