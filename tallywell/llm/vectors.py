"""Integer vectors: tables of kept ones, and Arrow batches of them as matrices."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components stop at +-LIMIT, so that sums of 4 * LIMIT**2 over 64 components, distances that is, fit in a long.
LIMIT = isqrt(2**62 // 64) // 2


def finite(vector: Column) -> Column:
    """The vector is there, and all its components are finite numbers."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def integers(rows: DataFrame, vec_col: str, scale: int, *others: Column) -> DataFrame:
    """others, and ``vector``: floor(scale * x) of each component as a double, of the rows whose vector is finite.

    Components beyond +-LIMIT (x of 2,097,152 at a scale of 64) count as LIMIT.
    """
    v = rows[vec_col].cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x * float(scale)))).cast("long"))
    return rows.filter(finite(v)).select(*others, whole.alias("vector"))


def width(vectors: DataFrame) -> int:
    """The most components of a vector."""
    return vectors.agg(F.max(F.size("vector"))).first()[0] or 0


def matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """A row for each vector; shorter ones end in zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    off = np.asarray(vectors.offsets, np.int64)
    values = np.asarray(vectors.values, np.int64)[off[0] : off[-1]]
    lengths = np.diff(off)
    if (lengths == size).all():
        return values.reshape(-1, size)
    out = np.zeros((len(lengths), size), np.int64)
    out[np.arange(size) < lengths[:, None]] = values
    return out
