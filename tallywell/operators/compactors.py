"""Quantiles from compactors: a KLL sketch whose levels grow with its stream, with states as rows.

A state is rows (by, level, values): a value of level i stands for 2**i values of
the stream. A level that outgrows its share is sorted and every other value, from
a seeded start, moves up; the others go. Weights always add up to the number of
values. States of any two shards are merged level by level, and compacted again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: States that one task merges.
FAN_IN = 16
#: Groups that a task holds at once; further ones send what is there on its way.
_GROUPS = 4096


def _room(k: int, level: int, levels: int) -> int:
    """Values that a level may hold: k at the top, and two thirds of the next one up below it."""
    return max(8, int(np.ceil(k * (2 / 3) ** (levels - 1 - level))))


def compact(levels: list[np.ndarray], k: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Until the levels together are within their room; a new one starts when the top is full."""
    levels = list(levels) or [np.zeros(0)]
    while sum(map(len, levels)) > sum(_room(k, i, len(levels)) for i in range(len(levels))):
        i = next((i for i, v in enumerate(levels) if len(v) > _room(k, i, len(levels))), len(levels) - 1)
        if i + 1 == len(levels):
            levels.append(np.zeros(0))
        v = np.sort(levels[i])
        stays = np.zeros(0)
        if len(v) % 2:  # the least or the largest stays where it is
            stays, v = (v[:1], v[1:]) if rng.integers(2) else (v[-1:], v[:-1])
        levels[i], levels[i + 1] = stays, np.concatenate([levels[i + 1], v[rng.integers(2) :: 2]])
    return levels


def sketch(df: DataFrame, value: str, k: int = 200, by: Sequence[str] = (), seed: int = 1, shard: str | None = None) -> DataFrame:
    """(by, shard, level, values, least, largest): a state for each task, or for each value of ``shard``, and group.

    A task holds about 3 k values for each of at most 4,096 groups. Which half of
    a level moves is drawn from the seed, the shard or task, and the group, so a task that runs again gives the
    same. Nulls and NaN are no values; a group without any has no state.
    """
    keys = [*by, *([shard] if shard else [])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def out() -> pd.DataFrame:
            rows = [(*key, i, v.tolist(), lo, hi) for key, (levels, _, lo, hi) in held.items() for i, v in enumerate(levels) if len(v)]
            held.clear()
            return pd.DataFrame(rows, columns=[*keys, "level", "values", "least", "largest"])

        for f in frames:
            f = f[~f["value"].isna()]
            for key, part in f.groupby(keys, sort=False, dropna=False)["value"] if keys else [((), f["value"])]:
                v = part.to_numpy(np.float64)
                if not len(v):
                    continue
                key = key if isinstance(key, tuple) else (key,)
                key = tuple(None if pd.isna(x) else x for x in key)
                if key not in held:
                    if len(held) >= _GROUPS:
                        yield out()
                    draws = [seed, 0 if shard else TaskContext.get().partitionId(), *map(ord, str(key))]
                    held[key] = [[np.zeros(0)], np.random.default_rng(draws), np.inf, -np.inf]
                h = held[key]
                for a in range(0, len(v), 4 * k):
                    h[0][0] = np.concatenate([h[0][0], v[a : a + 4 * k]])
                    h[0] = compact(h[0], k, h[1])
                h[2], h[3] = min(h[2], v.min()), max(h[3], v.max())
        if held:
            yield out()

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keys)
    parts = df.select(*keys, F.col(value).cast("double").alias("value")).mapInPandas(run, f"{kinds}level int, values array<double>, least double, largest double")
    return parts if shard else parts.withColumn("shard", F.spark_partition_id().cast("long")).select(*by, "shard", "level", "values", "least", "largest")


def merge(states: DataFrame, k: int = 200, by: Sequence[str] = (), shards: int | None = None, seed: int = 1) -> DataFrame:
    """(by, level, values, least, largest): one state for each group, in rounds in which a task merges FAN_IN shards of a group.

    shards: about how many there are, 4,096 if not given; it sets the rounds, so that a task gets FAN_IN states or so, of some 3 k values each.
    """
    if "shard" not in states.columns:
        raise ValueError("states have no shard")
    rounds, n = 0, shards or 4096
    while n > 1:
        rounds, n = rounds + 1, -(-n // FAN_IN)
    schema = states.schema
    kinds = "".join(f"`{c}` {schema[c].dataType.simpleString()}, " for c in by)
    now = states.withColumn("shard", F.pmod(F.xxhash64("shard"), F.lit(FAN_IN**rounds)) if rounds else F.lit(0).cast("long"))

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        top = int(f["level"].max()) + 1
        parts = [[v for at, v in zip(f["level"], f["values"]) if at == i] for i in range(top)]
        levels = [np.sort(np.concatenate([*map(np.asarray, p)])) if p else np.zeros(0) for p in parts]
        levels = compact(levels, k, np.random.default_rng([seed, top, int(sum(map(len, levels)))]))
        rows = [(*key, i, v.tolist(), f["least"].min(), f["largest"].max()) for i, v in enumerate(levels) if len(v)]
        return pd.DataFrame(rows, columns=[*by, "shard", "level", "values", "least", "largest"])

    for _ in range(rounds):
        now = now.withColumn("shard", F.expr(f"shard div {FAN_IN}"))
        now = now.groupBy(*by, "shard").applyInPandas(run, f"{kinds}shard long, level int, values array<double>, least double, largest double")
    return now.drop("shard")


def _weighted(state: DataFrame, by: Sequence[str]) -> DataFrame:
    return state.select(*by, F.explode("values").alias("v"), F.pow(F.lit(2.0), F.col("level")).cast("long").alias("n"))


def quantiles(state: DataFrame, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, q, value): the value at rank ceil(q n) of what the state stands for; the least and largest are exact."""
    part = [F.col(c) for c in by] or [F.lit(0)]
    run = _weighted(state, by).withColumn("upto", F.sum("n").over(W.partitionBy(*part).orderBy("v"))).withColumn("all", F.sum("n").over(W.partitionBy(*part)))
    at = lambda q: F.greatest(F.ceil(F.lit(float(q)) * F.col("all")), F.lit(1))
    got = run.groupBy(*by).agg(*[F.min(F.when(F.col("upto") >= at(q), F.col("v"))).alias(f"_q{i}") for i, q in enumerate(qs)])
    ends = state.groupBy(*by).agg(F.min("least").alias("_least"), F.max("largest").alias("_largest"))
    both = got.join(ends, list(by)) if by else got.crossJoin(F.broadcast(ends))  # one row each
    value = lambda i, q: F.col("_least") if q <= 0 else F.col("_largest") if q >= 1 else F.col(f"_q{i}")
    return both.filter("_least IS NOT NULL").select(*by, F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), value(i, q).alias("value")) for i, q in enumerate(qs)])).alias("x")).select(*by, "x.*")


def ranks(state: DataFrame, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, x, share): the share of values that are x at most."""
    n = F.sum("n")
    shares = [F.struct(F.lit(float(x)).alias("x"), (F.sum(F.when(F.col("v") <= x, F.col("n")).otherwise(0)) / n).alias("share")) for x in at]
    return _weighted(state, by).groupBy(*by).agg(F.array(*shares).alias("s"), n.alias("_n")).filter("_n > 0").select(*by, F.explode("s").alias("s")).select(*by, "s.*")


def kept(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, held, levels, least, largest): what the state stands for, and how many values it holds."""
    return state.groupBy(*by).agg(F.sum(F.size("values") * F.pow(F.lit(2.0), F.col("level"))).cast("long").alias("n"), F.sum(F.size("values")).cast("long").alias("held"), F.max("level").alias("levels"), F.min("least").alias("least"), F.max("largest").alias("largest"))


def rank_error(k: int) -> float:
    """What the rank of an answer is off by at most, in 99 of 100 sketches: the published fit for this compactor's shape."""
    return 2.296 / k**0.9021
