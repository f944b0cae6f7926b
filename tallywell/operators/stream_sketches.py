"""Sketches whose state depends on the order of the stream, or that Spark builds in.

The order-dependent ones run once for each partition (a shard) and leave at most
``capacity`` rows of it, which are merged by an aggregation. The state of a shard
is bounded, and so is all that is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import P, cw, leading
from . import sketches as S
from .exact import quantiles


def _raising(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[pa.RecordBatch]:
    """Rows in order -> those that raise their register above all before them here."""
    best = np.zeros(m, np.int64)
    for batch in batches:
        b, rho = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("b", "rho"))
        keep = []
        for i in np.flatnonzero(rho > best[b]):
            if rho[i] > best[b[i]]:
                best[b[i]] = rho[i]
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def hll_hip(df: DataFrame, key: Column, order: Sequence[str], lg: int) -> DataFrame:
    """(estimate): HyperLogLog's historic-inverse-probability estimate over rows in the given order; it can't be merged.

    Only rows that raise their register count: the estimate adds, for each, the
    inverse of the chance that a new key raises any register. That chance follows from the raises before. Null is no key.

    A row that raises its register raises it among the rows of its task too, so
    each task sorts its own rows, wherever they are of the order, and gives out those that do: about
    registers x ln(rows / registers) of them, each register at most 32 times. They alone are shuffled, and put in one order.
    """
    m = 1 << lg
    h = df.filter(key.isNotNull()).select(*order, (cw(key, 0, 20) % m).alias("b"), leading(cw(key, 1, 20)).cast("long").alias("rho"))
    few = h.sortWithinPartitions(*order).mapInArrow(lambda it: _raising(it, m), h.schema)
    best = F.max("rho").over(W.partitionBy("b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    raises = few.withColumn("old", F.coalesce(best, F.lit(0))).filter("rho > old")
    less = F.pow(F.lit(2.0), -F.col("old")) - F.pow(F.lit(2.0), -F.col("rho"))
    lost = F.coalesce(F.sum(less).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return raises.select((m / (m - lost)).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("estimate"))


def sampled(df: DataFrame, row_key: Column, rate: float, salt: int = 70, row: int = 0) -> DataFrame:
    """Rows drawn by a hash of their key: the same rows in every run and in every partitioning."""
    return df.filter(cw(row_key, row, salt) < int(rate * P))


def nitro(df: DataFrame, row_key: Column, key: Column, rate: float, rows: int, cols: int, signed: bool) -> DataFrame:
    """(r, c, n): a matrix that takes each update of each row with probability rate, as 1 / rate. Null keys are not counted."""
    cell = lambda r: F.struct(F.lit(r).alias("r"), (cw(F.col("_k"), r) % cols).cast("int").alias("c"), (S.sign(F.col("_k"), r) if signed else F.lit(1)).cast("long").alias("s"), (cw(F.col("_id"), r, 70) < int(rate * P)).alias("drawn"))
    x = df.select(row_key.alias("_id"), key.alias("_k")).filter("_k IS NOT NULL").select(S._rows(rows, cell).alias("x")).filter("x.drawn")
    return x.groupBy("x.r", "x.c").agg((F.sum("x.s") / rate).alias("n"))


def nitro_estimate(state: DataFrame, probes: DataFrame, key: Column, rows: int, cols: int, signed: bool) -> DataFrame:
    """The median over rows, for either kind: sampling makes Count-Min's cells err both ways."""
    own = list(probes.columns)
    asked = probes.withColumn("_k", key).withColumn("x", S._rows(rows, lambda r: F.struct(F.lit(r).alias("r"), (cw(F.col("_k"), r) % cols).cast("int").alias("c"), (S.sign(F.col("_k"), r) if signed else F.lit(1)).cast("long").alias("s"))))
    got = asked.select(*own, "x.r", "x.c", "x.s").join(F.broadcast(state), ["r", "c"], "left")
    return got.groupBy(*own).agg(F.element_at(F.sort_array(F.collect_list(F.coalesce("n", F.lit(0.0)) * F.col("s") + F.lit(0.0))), rows // 2 + 1).alias("estimate"))


def uniform_quantiles(df: DataFrame, row_key: Column, value: str, rate: float, qs: Sequence[float]) -> DataFrame:
    return quantiles(sampled(df, row_key, rate), value, qs)


def kll(df: DataFrame, value: str, k: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """(by, sketch): Spark's KLL sketch."""
    return df.groupBy(*by).agg(F.expr(f"kll_sketch_agg_double({value}, {k})").alias("sketch"))


def kll_merge(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return states.groupBy(*by).agg(F.expr("kll_merge_agg_double(sketch)").alias("sketch"))


def kll_quantiles(state: DataFrame, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    return state.select(*by, F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.expr(f"kll_sketch_get_quantile_double(sketch, {float(q)}D)").alias("value")) for q in qs])).alias("x")).select(*by, "x.q", "x.value")


def kll_ranks(state: DataFrame, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    return state.select(*by, F.explode(F.array(*[F.struct(F.lit(float(v)).alias("x"), F.expr(f"kll_sketch_get_rank_double(sketch, {float(v)}D)").alias("share")) for v in at])).alias("x")).select(*by, "x.x", "x.share")


# -- order-dependent heavy hitters ---------------------------------------------------------------------------------


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(key, times) over a shard: keys of each batch in the order of their first occurrence, with their counts in it."""
    for f in frames:
        codes, keys = pd.factorize(f["key"])
        yield from zip(keys.tolist(), np.bincount(codes, minlength=len(keys)).tolist())


def space_saving(df: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, n, over): for each of at most ``capacity`` keys an upper bound of its count, and by how much it may be over.

    A key that finds no room takes the place of the least count, and adds to it.
    Shards are merged by adding bounds; a key absent from a full shard may have
    had that shard's least count there, which goes to both n and over. Null keys are not counted.
    """
    import heapq

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        heap: list = []
        for k, n in _runs(frames):
            if k in held:
                held[k][0] += n
            elif len(held) < capacity:
                held[k] = [n, 0]
                heapq.heappush(heap, (n, k))
            else:
                while True:  # counts in the heap may be behind
                    least, old = heap[0]
                    if held[old][0] == least:
                        break
                    heapq.heapreplace(heap, (held[old][0], old))
                del held[old]
                held[k] = [least + n, least]
                heapq.heapreplace(heap, (least + n, k))
        floor = min(v[0] for v in held.values()) if len(held) >= capacity else 0
        if held:
            yield pd.DataFrame({"key": list(held), "n": [v[0] for v in held.values()], "over": [v[1] for v in held.values()], "floor": floor})

    kind = df.schema[key].dataType.simpleString()
    shards = df.select(F.col(key).alias("key")).filter("key IS NOT NULL").mapInPandas(run, f"key {kind}, n long, over long, floor long").withColumn("shard", F.spark_partition_id())
    floors = shards.groupBy("shard").agg(F.max("floor").alias("f")).agg(F.sum("f").alias("all"))
    merged = shards.groupBy("key").agg(F.sum("n").alias("n"), F.sum("over").alias("over"), F.sum("floor").alias("had")).crossJoin(F.broadcast(floors))  # one row
    absent = F.col("all") - F.col("had")
    return merged.select("key", (F.col("n") + absent).alias("n"), (F.col("over") + absent).alias("over")).orderBy(F.desc("n"), "key").limit(capacity)


def elastic(df: DataFrame, key: str, buckets: int, rows: int, cols: int, ratio: int = 8) -> DataFrame:
    """(key, n): heavy keys; each bucket keeps a key, votes for it and votes against, and lets a key in when votes against
    reach ``ratio`` times those for it. What is let go is counted in a Count-Min matrix, whose estimate is added back. Null keys are not counted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place: dict = {}
        light: dict = {}
        for k, n in _runs(frames):
            b = hash(k) % buckets
            held = place.get(b)
            if held is None:
                place[b] = [k, n, 0]
            elif held[0] == k:
                held[1] += n
            else:
                held[2] += n
                if held[2] >= ratio * held[1]:
                    light[held[0]] = light.get(held[0], 0) + held[1]
                    place[b] = [k, n, 0]
                else:
                    light[k] = light.get(k, 0) + n
            if len(light) >= 1 << 16:
                yield pd.DataFrame({"key": list(light), "n": list(light.values()), "heavy": False})
                light = {}
        yield pd.DataFrame({"key": [v[0] for v in place.values()] + list(light), "n": [v[1] for v in place.values()] + list(light.values()), "heavy": [True] * len(place) + [False] * len(light)})

    kind = df.schema[key].dataType.simpleString()
    parts = df.select(F.col(key).alias("key")).filter("key IS NOT NULL").mapInPandas(run, f"key {kind}, n long, heavy boolean")
    k = F.pmod(F.col("key").cast("long"), F.lit(P)) if kind in ("bigint", "int") else F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("long")
    light = S.matrix(parts.filter("NOT heavy"), k, rows, cols, weight=F.col("n"))
    heavy = parts.filter("heavy").groupBy("key").agg(F.sum("n").alias("held"))
    e = S.estimate(light, heavy, k, rows, cols)
    return e.select("key", (F.col("held") + F.col("estimate")).alias("n"))


def coco(df: DataFrame, key: str, rows: int, cols: int, seed: int = 1) -> DataFrame:
    """(key, n): each key adds to the least of its ``rows`` buckets, and takes it over with the probability n / new total. Null keys are not counted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        table: list[list] = [[None, 0] for _ in range(rows * cols)]
        for k, n in _runs(frames):
            mine = [r * cols + hash((k, r)) % cols for r in range(rows)]
            at = next((i for i in mine if table[i][0] == k), None)
            if at is None:
                at = min(mine, key=lambda i: table[i][1])
                if rng.random() * (table[at][1] + n) < n:
                    table[at][0] = k
            table[at][1] += n
        got = [(k, n) for k, n in table if n]
        if got:
            yield pd.DataFrame(got, columns=["key", "n"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key")).filter("key IS NOT NULL").mapInPandas(run, f"key {kind}, n long").groupBy("key").agg(F.sum("n").alias("n"))
