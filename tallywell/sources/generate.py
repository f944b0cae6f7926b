"""Deterministic tables and labelled series, generated in place: every value is a function of a row id and a seed.

Uniform numbers come from arithmetic hashes of the id, so the same rows come out
of any partitioning, of a task that runs again, and of another SQL engine.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import P, cw
from ..model import Unsupported


def uniform(row: Column, seed: int) -> Column:
    """In (0, 1), from two hashes in turn: one alone would be an arithmetic progression in the ids."""
    return (cw(cw(row + 1, seed % 40, 7).bitwiseXOR(F.shiftright(cw(row + 1, seed % 40 + 1, 8), 9)), seed % 40 + 2, 9) + 0.5) / float(P)


def normal(row: Column, seed: int, mean: float = 0.0, sd: float = 1.0) -> Column:
    return mean + sd * F.sqrt(-2 * F.log(uniform(row, seed))) * F.cos(2 * math.pi * uniform(row, seed + 3))


def pareto(row: Column, seed: int, scale: float, alpha: float) -> Column:
    if scale <= 0 or alpha <= 0:
        raise Unsupported(f"pareto({scale}, {alpha})", "both must be positive")
    return scale * F.pow(1 - uniform(row, seed), F.lit(-1.0 / alpha))


def between(row: Column, seed: int, low: float, high: float) -> Column:
    if not low < high:
        raise Unsupported(f"uniform [{low}, {high})", "empty")
    return low + uniform(row, seed) * (high - low)


@functools.lru_cache(8)
def _shares(n: int, s: float) -> np.ndarray:
    c = np.cumsum(np.arange(1, n + 1, dtype=float) ** -s)
    return c / c[-1]


def zipf(row: Column, seed: int, n: int, s: float) -> Column:
    """Ranks 1..n with weight rank ** -s; the table of n cumulative weights is made once in each worker."""

    @F.pandas_udf("long")
    def rank(u: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(_shares(n, s), u.to_numpy(), "right") + 1).clip(upper=n)

    return rank(uniform(row, seed))


def whole(value: Column, unsigned: bool = False) -> Column:
    """Truncated toward zero and held within the type: 64-bit, or unsigned as decimal(20, 0)."""
    low, high = (0.0, 1.8446744073709552e19) if unsigned else (-9.223372036854775e18, 9.223372036854775e18)
    held = F.when(F.isnan(value), 0.0).otherwise(F.least(F.greatest(value, F.lit(low)), F.lit(high)))
    return held.cast("decimal(38,0)").cast("decimal(20,0)") if unsigned else held.cast("long")


def text(rank: Column, length: int = 8, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """A different string for each rank below len(alphabet) ** length: the rank in that base, filled up from its hash."""
    base = len(alphabet)
    digit = lambda i: F.pmod(F.floor(rank / F.lit(float(base**i))).cast("long"), F.lit(base))
    return F.concat(*[F.substring(F.lit(alphabet), digit(i).cast("int") + 1, F.lit(1)) for i in range(length)])


def monotone(df: DataFrame, value: str, row: str, by: Sequence[str] = (), start: float = 0.0) -> DataFrame:
    """value becomes start + the running sum of its positive part; beyond 2**53 that is an error."""
    run = start + F.sum(F.greatest(F.col(value), F.lit(0.0))).over(W.partitionBy(*by).orderBy(row)) - F.first(F.greatest(F.col(value), F.lit(0.0))).over(W.partitionBy(*by).orderBy(row))
    return df.withColumn(value, F.when(run > 2.0**53, F.raise_error(F.lit(f"{value} is beyond 2**53")).cast("double")).otherwise(run))


def connected(row: Column, seed: int, sizes: Sequence[int]) -> list[Column]:
    """Columns that share one draw: each takes its digit of it, so that together they have a joint distribution."""
    draw, out, below = cw(cw(row + 1, seed % 40, 11), seed % 40 + 1, 12), [], 1
    for n in sizes:
        out.append((F.floor(draw / F.lit(float(below))) % n).cast("long"))
        below *= n
    return out


def child(parent: Column, row: Column, seed: int, fan_out: int) -> Column:
    """A label below its parent: parent.index."""
    return F.concat(parent.cast("string"), F.lit("."), F.floor(uniform(row, seed) * fan_out).cast("string"))


def scaled_by(value: Column, label: Column, seed: int, low: float, high: float) -> Column:
    """value times a factor of its label, log-uniform in low..high."""
    u = (cw(F.conv(F.substring(F.md5(label.cast("string")), 1, 8), 16, 10).cast("long"), seed % 40, 13) + 0.5) / float(P)
    return value * low * F.pow(F.lit(high / low), u)


def relabel(key: Column, offset: int | str) -> Column:
    return F.concat(F.lit(offset), key) if isinstance(offset, str) else key + offset


def with_bursts(df: DataFrame, row: str, length: int, bursts: Sequence[int], share: float, seed: int = 1) -> DataFrame:
    """df and, for each interval of ``length`` rows in ``bursts``, a share of its rows once more."""
    again = df.filter(F.floor(F.col(row) / length).isin(list(bursts))).filter(uniform(F.col(row), seed) < share)
    return df.withColumn("burst", F.lit(False)).union(again.withColumn("burst", F.lit(True)))


def table(spark: SparkSession, rows: int | DataFrame, **columns: Column) -> DataFrame:
    """id and the given columns of it. rows: how many, or a table whose ``id`` it is, so that what is generated goes with given rows."""
    ids = rows if isinstance(rows, DataFrame) else spark.range(rows)
    return ids.select("id", *[c.alias(n) for n, c in columns.items()])


def claimed(df: DataFrame, **claims: int) -> DataFrame:
    """df, if each column has as many different values as is claimed; another number is an error that says what there is."""
    found = df.agg(*[F.countDistinct(c).alias(c) for c in claims]).first()
    wrong = {c: found[c] for c, n in claims.items() if found[c] != n}
    if wrong:
        raise Unsupported(f"claimed cardinalities {claims}", f"there are {wrong}")
    return df


def series(spark: SparkSession, labels: DataFrame, start_ms: int, duration_ms: int, interval_ms: int, value, counter: bool = False) -> DataFrame:
    """(labels..., ts_ms, value): a sample for each label combination at start + interval, ..., start + duration.

    value: a function of (series number, step) columns. counter: the running sum of its positive part.
    """
    names = labels.columns
    numbered = labels.withColumn("_series", F.pmod(F.xxhash64(*names), F.lit(P)))
    steps = duration_ms // interval_ms
    numbered = numbered.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(steps)).cast("array<long>"))) if steps else numbered.withColumn("_step", F.lit(0).cast("long")).limit(0)
    rows = numbered.withColumn("value", value(F.col("_series"), F.col("_step")))  # every series at every step of the grid
    if counter:
        rows = rows.withColumn("value", F.sum(F.greatest("value", F.lit(0.0))).over(W.partitionBy(*names).orderBy("_step")))
    return rows.select(*names, (F.lit(start_ms) + F.col("_step") * interval_ms).cast("long").alias("ts_ms"), "value")


def weighted_labels(labels: DataFrame, weight: str, n: int, seed: int = 1) -> DataFrame:
    """n label combinations drawn without replacement, by weight: those with the least -ln(u) / weight."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *[c for c in labels.columns if c != weight]), F.lit(P)) + 0.5) / float(P)
    return labels.orderBy(-F.log(u) / F.col(weight), *[c for c in labels.columns if c != weight]).limit(n)


def phased(offset_ms: Column, phases: Sequence[dict]) -> Column:
    """A factor over time: of phases [{start_ms, end_ms, scale, ramp_ms}], 1 outside, linear over the ramp at the start of each."""
    out = F.lit(1.0)
    for p in phases:
        done = F.least(F.lit(1.0), (offset_ms - p["start_ms"]) / float(p["ramp_ms"])) if p.get("ramp_ms") else F.lit(1.0)
        out = F.when((offset_ms > p["start_ms"]) & (offset_ms <= p["end_ms"]), 1 + (p["scale"] - 1) * done).otherwise(out)
    return out
