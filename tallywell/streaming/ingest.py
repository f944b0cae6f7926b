"""Panes kept by a stream: each micro-batch adds its panes, and they merge when read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans import panes as P


def stream_samples(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def keep_panes(samples: DataFrame, out: str, checkpoint: str, width: int, labels: Sequence[str], strict: bool = True) -> StreamingQuery:
    """Writes panes of every micro-batch to ``out``/batch=n, once each: a batch that is run again replaces its own folder.

    strict: a sample at or before the end of a pane that an earlier batch has
    gone beyond by more than one pane is an error, where a watermark would drop it unseen.
    """

    def add(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        last = _mark(spark, out, n - 1) if strict else None
        if last is not None and not batch.filter(F.col("ts_ms") <= last - 2 * width).isEmpty():
            raise ValueError(f"batch {n} has samples more than one pane before {last - width}")
        P.build(batch, width, labels).write.mode("overwrite").parquet(f"{out}/batch={n}")
        if strict:
            ends = spark.read.parquet(f"{out}/batch={n}").agg(F.max("window_end").alias("last"))
            ends.select(F.greatest("last", F.lit(last).cast("long")).alias("last")).coalesce(1).write.mode("overwrite").parquet(f"{out}/_last/batch={n}")

    return samples.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _mark(spark: SparkSession, out: str, batch: int) -> int | None:
    """The end of the last pane of a batch and all before it: one row that the batch has left, so that panes aren't read again."""
    return spark.read.schema("last long").parquet(f"{out}/_last/batch={batch}").first()[0] if batch >= 0 else None


def read_panes(spark: SparkSession, out: str, before: int | None = None) -> DataFrame | None:
    """The panes of all batches; parts of one pane are merged by plans.panes.roll_up at the same width."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    except AnalysisException:
        return None
    df = df if before is None else df.filter(F.col("batch") < before)
    return df.drop("batch")


def stream_counts(samples: DataFrame, width: int, labels: Sequence[str], lateness: str = "0 seconds") -> DataFrame:
    """Streaming counts and sums by right-closed pane: the event time is moved back by a millisecond, so that Spark's
    left-closed window holds (end - width, end]."""
    at = F.timestamp_millis(F.col("ts_ms") - 1)
    w = F.window("_at", f"{width} milliseconds")
    got = samples.withColumn("_at", at).withWatermark("_at", lateness).groupBy(w.alias("_w"), *labels).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.unix_millis("_w.end").alias("window_end"), *labels, "n", "total")
