"""Shared-folder tables and shuffle clean-up for jobs of several steps."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests, a laptop) a
    folder of our own is made and set; a cluster without the setting is an error,
    since it must never get a machine-local one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tallywell/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there,
    and a lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of about ``BATCH_BYTES`` instead of Spark's default, 64 MB; a setting of the session's own stays.

    Each core holds a batch several times: twice in the executor while its buffer
    grows, in the worker, and once more on the way back. Workers cut what they get
    into smaller pieces still (``words.blocks``). Spark reads the setting when a
    plan runs, so it is left to the session.
    """
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, BATCH_BYTES)


def settle(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished steps.

    The cleaner acts when the driver's JVM collects garbage, every
    ``spark.cleaner.periodicGC.interval`` at the latest; between two steps that
    each shuffle a corpus that is too late for the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of a side that may be broadcast: at most some tens of MB in each use.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, which is a written table, marked for broadcast if it is small; else joins with it shuffle."""
    return F.broadcast(df) if df.count() <= rows else df
