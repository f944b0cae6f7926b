"""Errors over trials instead of keys: the same stream under other labels or other hash functions, all trials in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import P, coefficients
from ..model import Unsupported
from . import sketches as S

#: By how much a trial moves integer keys.
OFFSET = 1 << 40


def drawn_again(counts: DataFrame, key: Column, trials: int, mode: str) -> DataFrame:
    """counts once for each trial, with ``trial`` and ``_key``, a key below p for the hash family.

    relabel: trial i adds i * 2**40 to every key, so that the family meets other keys.
    reseed: it meets the same keys behind a bijection that is the trial's own, which is as good as other
    coefficients. Trial 0 of relabel is the stream as it is.
    """
    rows = counts.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("_of", F.pmod(key.cast("long"), F.lit(P)))
    if mode == "relabel":
        return rows.withColumn("_key", F.pmod(F.col("_of") + F.col("trial").cast("long") * (OFFSET % P), F.lit(P))).drop("_of")
    if mode != "reseed":
        raise Unsupported(f"trials by {mode}", "not relabel or reseed")
    a, b = (F.get(F.array(*[F.lit(coefficients(t, 77)[i]).cast("long") for t in range(trials)]), F.col("trial")) for i in (0, 1))
    return rows.withColumn("_key", (a * F.col("_of") + b) % P).drop("_of")


def frequency_errors(counts: DataFrame, key: Column, n: str, trials: int, mode: str, rows: int, cols: int, signed: bool = False) -> DataFrame:
    """(trial, error): by trial the mean of |estimate - n| over the keys, as a share of the stream.

    counts(key, n) has each key once: a sketch is linear, so its cells of all
    trials come from the counts, cells x trials of them.
    """
    again = drawn_again(counts, key, trials, mode)
    cells = S.matrix(again, F.col("_key"), rows, cols, signed, F.col(n), by=["trial"])
    read = S.estimate(cells, again.select("trial", "_key", n), F.col("_key"), rows, cols, signed, by=["trial"])
    return read.groupBy("trial").agg((F.avg(F.abs(F.col("estimate") - F.col(n))) / F.sum(n)).alias("error"))


def cardinality_errors(keys: DataFrame, key: Column, trials: int, mode: str, lg: int) -> DataFrame:
    """(trial, error): by trial HyperLogLog's relative error; keys has each key once."""
    again = drawn_again(keys, key, trials, mode)
    read = S.hll_estimate(S.registers(again, F.col("_key"), lg, ["trial"]), lg, ["trial"])
    truth = again.groupBy("trial").agg(F.countDistinct("_key").alias("_n"))
    return read.join(truth, "trial").select("trial", (F.abs(F.col("estimate") - F.col("_n")) / F.col("_n")).alias("error"))
