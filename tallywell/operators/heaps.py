"""Heavy keys from bounded heaps: what a task keeps beside its cells, so that no plan groups a stream by its keys.

A task fills one array of cells and holds the keys of the greatest estimates; what it
sends is the cells and those keys. Or, with a matrix that is there already, a
second pass holds the keys of the greatest final estimates, which misses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import cw, level, sign
from ..model import Unsupported
from ..storage import save
from . import sketches as S

#: Cells of an array that a task fills; larger matrices are made by an aggregation (sketches.matrix).
MOST_CELLS = 1 << 22


def _cells(key: Column, rows: int, cols: int, signed: bool) -> list[Column]:
    """For each matrix row the cell's place in one array, with the sign in the lowest bit."""
    bit = lambda r: F.when(sign(key, r) < 0, 1).otherwise(0) if signed else F.lit(0)
    return [((F.lit(r * cols).cast("long") + cw(key, r) % cols) * 2 + bit(r)).alias(f"_x{r}") for r in range(rows)]


def _columns(b: pa.RecordBatch, rows: int) -> np.ndarray:
    return np.stack([b.column(f"_x{r}").to_numpy(zero_copy_only=False) for r in range(rows)])


def _signs(x: np.ndarray) -> np.ndarray:
    return 1 - 2 * (x & 1)


def _dense(cells: np.ndarray, cols: int, extra: dict[str, pa.DataType] | None = None) -> pa.RecordBatch:
    at = np.flatnonzero(cells)
    columns = [pa.array(at // cols, pa.int32()), pa.array(at % cols, pa.int32()), pa.array(cells[at], pa.int64())]
    names = ["r", "c", "n"]
    for name, kind in (extra or {}).items():
        names.append(name)
        columns.append(pa.nulls(len(at), kind))
    return pa.RecordBatch.from_arrays(columns, names)


def filled(df: DataFrame, key: Column, rows: int, cols: int, signed: bool = False, weight: Column | None = None) -> DataFrame:
    """(r, c, n), the matrix that sketches.matrix makes, from one array for each task. Null keys are not counted."""
    if rows * cols > MOST_CELLS:
        raise Unsupported(f"{rows} x {cols} cells in a task", f"at most {MOST_CELLS}")
    weighed = weight is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(rows * cols, np.int64)
        for b in batches:
            x = _columns(b, rows)
            if not weighed and not signed:
                cells += np.bincount(x.ravel() >> 1, minlength=rows * cols)
            else:
                w = b.column("_w").to_numpy(zero_copy_only=False) if weighed else np.ones(b.num_rows, np.int64)
                np.add.at(cells, (x >> 1).ravel(), (_signs(x) * w).ravel())
        yield _dense(cells, cols)

    wide = df.withColumn("_k", key).filter("_k IS NOT NULL")
    parts = wide.select(*([weight.cast("long").alias("_w")] if weighed else []), *_cells(F.col("_k"), rows, cols, signed))
    return parts.mapInArrow(run, "r int, c int, n long").groupBy("r", "c").agg(F.sum("n").alias("n"))


def heaped(df: DataFrame, name: str, key: Column, rows: int, cols: int, heap: int, signed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cells, keys) in one pass: the matrix of all tasks together, and the keys that some task held in its heap.

    A task holds its cells and ``heap`` keys: those of the greatest estimates of its own cells so far, looked at anew
    with every batch. Cells are added up and keys put together by Spark: tasks x
    (cells + heap) rows move, whatever the stream. A key is in the result if some
    task holds it at its end; where a key is among the ``heap`` most frequent of a
    task by more than the estimates err, it is. Estimates are then read from the merged cells (sketches.estimate). Null keys are not counted.
    """
    if rows * cols > MOST_CELLS:
        raise Unsupported(f"{rows} x {cols} cells in a task", f"at most {MOST_CELLS}")
    kind = df.schema[name].dataType.simpleString()
    wide = df.withColumn("_k", key).filter("_k IS NOT NULL").select(F.col(name).alias("_key"), *_cells(F.col("_k"), rows, cols, signed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, places = np.zeros(rows * cols, np.int64), np.zeros((rows, 0), np.int64)
        held = arrow = None
        for b in batches:
            x, arrow = _columns(b, rows), b.schema.field("_key").type
            np.add.at(cells, (x >> 1).ravel(), _signs(x).ravel())
            codes, keys = pd.factorize(b.column("_key").to_pandas())
            first = np.empty(len(keys), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            keys = pd.Index(keys)
            new = ~keys.isin(held) if held is not None else np.ones(len(keys), bool)
            held, places = keys if held is None else held.append(keys[new]), np.concatenate([places, x[:, first[new]]], axis=1)
            if len(held) > heap:
                read = cells[places >> 1] * _signs(places)
                e = np.sort(read, axis=0)[rows // 2] if signed else read.min(axis=0)
                best = np.sort(np.argpartition(-e, heap - 1)[:heap])
                held, places = held[best], places[:, best]
        if arrow is not None:
            yield _dense(cells, cols, {"key": arrow})
            none = pa.nulls(len(held), pa.int32())
            yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(held), pa.int64()), pa.array(held.tolist(), arrow)], ["r", "c", "n", "key"])

    both = save(wide.mapInArrow(run, f"r int, c int, n long, key {kind}"), "heaps")  # both are read from it
    return both.filter("r IS NOT NULL").groupBy("r", "c").agg(F.sum("n").alias("n")), both.filter("r IS NULL").select(F.col("key").alias(name)).distinct()


def greatest(estimates: DataFrame, name: str, k: int) -> DataFrame:
    """estimates(name, estimate) of the rows of a stream -> the k keys of the greatest ones, ties to the smaller key.

    A key's estimate is the same in all its rows, so a task holds k keys, and none of the k greatest is missed.
    """
    kinds = ", ".join(f"`{c}` {estimates.schema[c].dataType.simpleString()}" for c in (name, "estimate"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = None, None
        for b in batches:
            schema = b.schema
            f = b.to_pandas().drop_duplicates(name)
            held = f if held is None else pd.concat([held, f]).drop_duplicates(name)
            held = held.sort_values(["estimate", name], ascending=[False, True]).head(k)
        if held is not None:
            yield pa.RecordBatch.from_pandas(held, schema, preserve_index=False)

    few = estimates.select(name, "estimate").mapInArrow(run, kinds)
    return few.distinct().orderBy(F.desc("estimate"), F.asc(name)).limit(k)


def univmon_pass(df: DataFrame, name: str, weight: Column, layers: int, rows: int, cols: int, heap: int) -> tuple[DataFrame, DataFrame]:
    """(cells, held) of UnivMon in one pass over a stream of non-negative integer keys with weights.

    A task holds a Count Sketch for each layer and, for each, ``heap`` keys of the
    greatest estimates of its own cells so far; layer j takes the keys that are
    sampled j times over. What moves is tasks x layers x (cells + heap) rows. cells:
    (layer, r, c, n) of all tasks together; held: (layer, k, deep, estimate), the ``heap`` greatest estimates, from the merged
    cells, of each layer's keys that some task held. Null keys are not counted; a null weight adds nothing.
    """
    if layers * rows * cols > MOST_CELLS:
        raise Unsupported(f"{layers} x {rows} x {cols} cells in a task", f"at most {MOST_CELLS}")
    wide = df.select(F.col(name).cast("long").alias("_key"), F.coalesce(weight.cast("long"), F.lit(0)).alias("_w")).filter("_key IS NOT NULL")
    wide = wide.select("_key", "_w", level(F.col("_key"), layers).cast("int").alias("_deep"), *_cells(F.col("_key"), rows, cols, True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((layers, rows * cols), np.int64)
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((rows, 0), np.int64)) for _ in range(layers)]
        for b in batches:
            x, deep = _columns(b, rows), b.column("_deep").to_numpy(zero_copy_only=False)
            keys, first, codes = np.unique(b.column("_key").to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
            w = np.zeros(len(keys), np.int64)
            np.add.at(w, codes, b.column("_w").to_numpy(zero_copy_only=False))
            x, deep = x[:, first], deep[first]
            for j in range(layers):
                here = deep >= j
                if not here.any():
                    break
                at = x[:, here]
                np.add.at(cells[j], (at >> 1).ravel(), (_signs(at) * w[here]).ravel())
                k, d, places = held[j]
                new = here & ~np.isin(keys, k)
                k, d, places = np.r_[k, keys[new]], np.r_[d, deep[new]], np.concatenate([places, x[:, new]], axis=1)
                if len(k) > heap:
                    e = np.sort(cells[j][places >> 1] * _signs(places), axis=0)[rows // 2]
                    best = np.argpartition(-e, heap - 1)[:heap]
                    k, d, places = k[best], d[best], places[:, best]
                held[j] = k, d, places
        names = ["layer", "r", "c", "n", "k", "deep"]
        for j in range(layers):
            at, (k, d, _) = np.flatnonzero(cells[j]), held[j]
            none = lambda n, t: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), j), pa.int32()), pa.array(at // cols, pa.int32()), pa.array(at % cols, pa.int32()), pa.array(cells[j][at]), none(len(at), pa.int64()), none(len(at), pa.int32())], names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), j), pa.int32()), *[none(len(k), t) for t in (pa.int32(), pa.int32(), pa.int64())], pa.array(k, pa.int64()), pa.array(d, pa.int32())], names)

    both = save(wide.mapInArrow(run, "layer int, r int, c int, n long, k long, deep int"), "univmon")
    cells = both.filter("k IS NULL").groupBy("layer", "r", "c").agg(F.sum("n").alias("n"))
    keys = both.filter("k IS NOT NULL").select("layer", "k", "deep").distinct()
    return cells, S.heaviest(S.estimate(cells, keys, F.col("k"), rows, cols, True, by=["layer"]), heap)
