"""Panes kept in the state of a stream: a pane is given out once, when it is complete, and late samples never go unseen.

A sample is late if the pane it belongs to ended ``lateness_ms`` or more before
the latest event of all batches before. Spark's own watermark would drop it
without a word; here the watermark lies ``horizon_ms`` behind, so that late samples
reach the operator, which knows the latest event as watermark + horizon. They are an error or go to a
table of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

STATE = "n long, total double, least double, largest double, first_ms long, first double, last_ms long, last double"
_NAMES = [x.split()[0] for x in STATE.split(", ")]
#: The state store: open panes lie on the executors' disks and not in their heaps.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Series are dealt to so many states, each of which is read and written as a whole.
BUCKETS = 4096


def _merged(parts: pd.DataFrame) -> pd.DataFrame:
    """One state for each (series, window_end) of some; which samples came in which batch makes no difference."""
    at = ["series", "window_end"]
    g = parts.groupby(at, sort=False)
    out = g.agg(n=("n", "sum"), total=("total", "sum"), least=("least", "min"), largest=("largest", "max"))
    first = parts.sort_values(["first_ms", "first"]).drop_duplicates(at).set_index(at)
    last = parts.sort_values(["last_ms", "last"]).drop_duplicates(at, keep="last").set_index(at)
    return out.join(first[["first_ms", "first"]]).join(last[["last_ms", "last"]]).reset_index()[[*at, *_NAMES]]


def _packed(panes: pd.DataFrame) -> bytes:
    t = pa.RecordBatch.from_pandas(panes, preserve_index=False).replace_schema_metadata(None)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        w.write_batch(t)
    return sink.getvalue().to_pybytes()


def _open(width: int, lateness: int, horizon: int):
    """The open panes of a bucket of series as one table, and a timer for the end of the first of them."""

    def frame(kind: str, panes: pd.DataFrame) -> pd.DataFrame:
        return panes.assign(kind=kind)[["series", "kind", "window_end", *_NAMES]]

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        latest = mark + horizon if mark > 0 else None
        held = [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []
        for f in batches:
            f = f.dropna(subset=["ts_ms", "value"])
            t, v = f["ts_ms"].astype("int64"), f["value"]
            one = pd.DataFrame({"series": f["series"], "window_end": ((t - 1) // width + 1) * width, "n": 1, "total": v, "least": v, "largest": v, "first_ms": t, "first": v, "last_ms": t, "last": v})
            if latest is not None:
                old = one["window_end"] + lateness <= latest
                if old.any():
                    yield frame("late", one[old])
                one = one[~old]
            if len(one):
                held = [_merged(pd.concat([*held, one], ignore_index=True))]
        panes = held[0] if held else None
        if panes is not None and latest is not None:
            done = panes["window_end"] + lateness <= latest
            if done.any():
                yield frame("pane", panes[done])
            panes = panes[~done]
        if panes is not None and len(panes):
            state.update((_packed(panes),))
            state.setTimeoutTimestamp(int(panes["window_end"].min()) + lateness - horizon)
        elif state.exists:
            state.remove()

    return step


def _written(label: str, kind: T.DataType) -> Column:
    """A label as a string from which it can be read again; null stays null."""
    x = F.col(label)
    return F.unix_micros(x).cast("string") if isinstance(kind, T.TimestampType) else F.hex(x) if isinstance(kind, T.BinaryType) else x.cast("string")


def _read(text: Column, kind: T.DataType) -> Column:
    return F.timestamp_micros(text.cast("long")) if isinstance(kind, T.TimestampType) else F.unhex(text) if isinstance(kind, T.BinaryType) else text.cast(kind)


def open_panes(samples: DataFrame, width: int, labels: Sequence[str], lateness_ms: int = 0, horizon_ms: int = 365 * 86_400_000, buckets: int = BUCKETS) -> DataFrame:
    """samples(labels, ts_ms, value), a stream -> (labels, kind, window_end, state): complete panes, and late samples as states of one sample.

    What is held: a state for each series and pane that is still open, so what
    a long stream holds is bounded by its series times lateness / width + 1 panes
    with samples, however long it runs. Series are dealt to ``buckets`` states by a hash; a task
    reads, adds to and writes a bucket's open panes at once, so its memory is that of one bucket,
    and a stream keeps the number it was started with. Samples without a time or a value are left
    out. Samples older than ``horizon_ms`` are dropped by Spark, which counts them
    (``numRowsDroppedByWatermark``); ``keep_complete`` takes that for an error too.
    Times must lie after the horizon's length from 1970 on.
    """
    if horizon_ms <= lateness_ms:
        raise ValueError("the horizon must lie behind the lateness that is allowed")
    kinds = {c: samples.schema[c].dataType for c in labels}
    series = F.to_json(F.array(*[_written(c, k) for c, k in kinds.items()])) if labels else F.lit("[]")
    bucket = F.pmod(F.xxhash64("series"), F.lit(buckets))
    timed = samples.select(series.alias("series"), "ts_ms", F.col("value").cast("double").alias("value"), F.timestamp_millis("ts_ms").alias("_at")).withColumn("bucket", bucket).withWatermark("_at", f"{horizon_ms} milliseconds")
    got = timed.groupBy("bucket").applyInPandasWithState(_open(width, lateness_ms, horizon_ms), f"series string, kind string, window_end long, {STATE}", "panes binary", "append", "EventTimeTimeout")
    read = got.withColumn("series", F.from_json("series", "array<string>"))
    return read.select(*[_read(F.get("series", F.lit(i)), k).alias(c) for i, (c, k) in enumerate(kinds.items())], "kind", "window_end", *_NAMES)


def keep_complete(samples: DataFrame, out: str, checkpoint: str, width: int, labels: Sequence[str], lateness_ms: int = 0, horizon_ms: int = 365 * 86_400_000, strict: bool = True) -> StreamingQuery:
    """Writes complete panes to ``out``/panes and late samples to ``out``/late, each batch to a folder of its own that a batch run again replaces.

    strict: a late sample fails its batch before anything is written or committed, so the stream stops there each time it is started.
    """
    spark = samples.sparkSession
    spark.conf.set(*PROVIDER)

    def add(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            late = batch.filter("kind = 'late'")
            if strict and not late.isEmpty():
                r = late.orderBy("first_ms").first()
                raise ValueError(f"batch {n} has late samples, the first at {r.first_ms} for the pane that ended at {r.window_end}")
            batch.filter("kind = 'pane'").drop("kind").write.mode("overwrite").parquet(f"{out}/panes/batch={n}")
            late.select(*labels, F.col("first_ms").alias("ts_ms"), F.col("first").alias("value"), "window_end").write.mode("overwrite").parquet(f"{out}/late/batch={n}")
        finally:
            batch.unpersist()

    return open_panes(samples, width, labels, lateness_ms, horizon_ms).writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(query: StreamingQuery, strict: bool = True) -> StreamingQuery:
    """Waits for the query; samples beyond the horizon, which never reached the operator, are an error if ``strict``."""
    query.awaitTermination()
    if strict:
        dropped = sum(s.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for s in p["stateOperators"])
        if dropped:
            raise ValueError(f"{dropped} samples lie beyond the horizon")
    return query


def complete(spark: SparkSession, out: str) -> DataFrame:
    """The panes given out so far."""
    return spark.read.option("basePath", f"{out}/panes").parquet(f"{out}/panes").drop("batch")


def late(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", f"{out}/late").parquet(f"{out}/late").drop("batch")
