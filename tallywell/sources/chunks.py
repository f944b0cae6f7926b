"""Samples as JSON lines, and their replay in chunks: each chunk has the samples up to an end in event time, and is handed on once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Unsupported


def write_lines(samples: DataFrame, path: str) -> None:
    """One JSON object a line; nulls stay as keys, so that every line has every field."""
    samples.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return text.withColumn("parsed", F.from_json("value", T.StructType([*schema.fields, T.StructField("_broken", T.StringType())]), {"columnNameOfCorruptRecord": "_broken"}))


def read_lines(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] = ("ts_ms",)) -> DataFrame:
    """The samples of the lines; blank lines count as none. A line that isn't such an object, or lacks a required field, is not among them: see malformed."""
    parsed = _lines(spark, path, schema).filter(F.trim("value") != "")
    return parsed.filter(_fine(required)).select("parsed.*").drop("_broken")


def _fine(required: Sequence[str]):
    ok = F.col("parsed._broken").isNull() & F.col("parsed").isNotNull()
    for c in required:
        ok = ok & F.col(f"parsed.{c}").isNotNull()
    return ok


def malformed(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] = ("ts_ms",)) -> DataFrame:
    """(file, line, value): lines that read_lines leaves out, with their numbers in their files from 1 on.

    Files are read in blocks by many tasks. Each gives out what is wrong with its
    place in the block, and how many lines a block has; those sums make numbers of places. Nothing but bad lines and a row for each block moves.
    """
    marked = _lines(spark, path, schema).withColumn("bad", ~_fine(required) & (F.trim("value") != "")).select("file", "block", "bad", F.when(F.col("bad"), F.col("value")).alias("value"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = {}
        for b in batches:
            out = []
            for file, block, bad, value in zip(*(b.column(c).to_pylist() for c in ("file", "block", "bad", "value"))):
                seen[file, block] = n = seen.get((file, block), 0) + 1
                if bad:
                    out.append((file, block, n, value))
            yield _batch(out, True)
        yield _batch([(*k, n, None) for k, n in seen.items()], False)

    def _batch(rows: list[tuple], bad: bool) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * 4
        types = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([*[pa.array(list(c), t) for c, t in zip(columns, types)], pa.array([bad] * len(rows), pa.bool_())], ["file", "block", "n", "value", "bad"])

    parts = marked.mapInArrow(number, "file string, block long, n long, value string, bad boolean")
    sizes = parts.filter("NOT bad").select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("n").alias("size"))
    wrong = parts.filter("bad").select("file", "block", "n", "value")
    before = wrong.join(sizes, (F.col("file") == F.col("_file")) & (F.col("_block") < F.col("block")), "left")
    return before.groupBy("file", "block", "n", "value").agg((F.col("n") + F.coalesce(F.sum("size"), F.lit(0))).alias("line")).select("file", "line", "value")


def cut(samples: DataFrame, ends: Sequence[int], out: str) -> None:
    """Writes ``out``/chunk=i for each of the ascending ends: samples after the end before and up to its own; what is after the last end is left out."""
    if not ends or list(ends) != sorted(set(ends)):
        raise Unsupported(f"chunk ends {list(ends)[:3]} ...", "they must ascend, and there must be some")
    bounds = F.array(*[F.lit(int(e)).cast("long") for e in ends])
    chunk = F.size(F.filter(bounds, lambda e: e < F.col("ts_ms")))
    samples.filter((F.col("ts_ms").isNotNull()) & (F.col("ts_ms") <= int(ends[-1]))).withColumn("chunk", chunk).repartition("chunk").write.mode("overwrite").partitionBy("chunk").parquet(out)


def replay(spark: SparkSession, chunks: str, schema: T.StructType, ends: Sequence[int], done: str, refresh: Callable[[DataFrame, int, int], None]) -> int:
    """Hands each chunk on in order, refresh(samples, i, end), and notes it in the table ``done``; gives the number handed on now.

    A chunk that is noted is not handed on again. One whose refresh was lost
    half-way is, with the same samples and number: a refresh that writes to a
    place named by its number counts every sample once. A chunk without samples is handed on too, since its end has come.
    """
    handed = 0
    noted = {r.chunk for r in spark.read.schema("chunk int, end long").parquet(done).collect()} if _there(spark, done) else set()
    for i, end in enumerate(ends):
        if i in noted:
            continue
        part = f"{chunks}/chunk={i}"
        refresh(spark.read.schema(schema).parquet(part) if _there(spark, part) else spark.createDataFrame([], schema), i, end)
        spark.createDataFrame([(i, int(end))], "chunk int, end long").coalesce(1).write.mode("append").parquet(done)
        handed += 1
    return handed


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
