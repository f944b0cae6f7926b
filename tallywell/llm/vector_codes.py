"""Product codes of vectors: integer codebooks by position, nearest entries by segment-mean lower bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bounded, save
from .vectors import integers, matrix, width

#: Rows whose bounds are held at once, in each task.
_BLOCK = 8192


def _levels(n: int) -> list[int]:
    """Blocks of each level, coarse to fine: 1, 2, 4, ... while a block holds two components or more."""
    return [b for b in (1 << i for i in range(n.bit_length())) if b == 1 or 2 * b <= n]


def _features(v: np.ndarray, blocks: int) -> np.ndarray:
    """By block, sqrt(n) times the mean and the norm of what is left: two such points lie no farther apart than their vectors."""
    parts = np.array_split(v.astype(np.float64), blocks, axis=1)
    out = []
    for p in parts:
        mean = p.mean(axis=1, keepdims=True)
        out += [mean[:, 0] * np.sqrt(p.shape[1]), np.sqrt(((p - mean) ** 2).sum(axis=1))]
    return np.stack(out, axis=1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry to each row of x, all int64; of equally near ones the first.

    The bound of the coarsest level, over all entries, names one whose exact
    distance no answer exceeds; entries whose bound exceeds it go, then those whose
    bound at the next level does, and so on. What is left is measured in integers.
    Bounds are doubles, and are lowered by more than they can be off before an entry goes by them.
    """
    n, at = len(x), np.arange(len(x))
    levels = _levels(x.shape[1])
    fx, fe = _features(x, 1), _features(entries, 1)
    bound = (fx[:, :1] - fe[:, 0]) ** 2 + (fx[:, 1:] - fe[:, 1]) ** 2
    slack = 1e-12 * ((fx**2).sum(axis=1)[:, None] + (fe**2).sum(axis=1)) + 1e-6
    best = ((x - entries[bound.argmin(axis=1)]) ** 2).sum(axis=1)
    row, entry = np.nonzero(bound - slack <= best[:, None])
    for blocks in levels[1:]:
        gx, ge = _features(x, blocks), _features(entries, blocks)
        finer = ((gx[row] - ge[entry]) ** 2).sum(axis=1)
        near = finer - slack[row, entry] <= best[row]
        row, entry = row[near], entry[near]
    exact = ((x[row] - entries[entry]) ** 2).sum(axis=1)
    least = np.minimum.reduceat(exact, np.searchsorted(row, at)) if n else exact
    hit = np.flatnonzero(exact == least[row])
    first = hit[np.searchsorted(row[hit], at)]
    return entry[first], least


def _parts(batches: Iterator[pa.RecordBatch], size: int, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of bounded length, and their vectors by part."""
    for batch in batches:
        for a in range(0, batch.num_rows, _BLOCK):
            b = batch.slice(a, _BLOCK)
            yield b, matrix(b.column("vector"), size).reshape(b.num_rows, parts, size // parts)


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(part, entry, place, total, n): what a task's rows add to each entry."""
    parts, count, w = books.shape
    totals, rows = np.zeros(books.shape, np.int64), np.zeros((parts, count), np.int64)
    for _, x in _parts(batches, parts * w, parts):
        for p in range(parts):
            code, _ = nearest(x[:, p], books[p])
            order = np.argsort(code, kind="stable")
            used, first = np.unique(code[order], return_index=True)
            totals[p][used] += np.add.reduceat(x[order, p], first, axis=0)
            rows[p] += np.bincount(code, minlength=count)
    p, e = np.nonzero(rows)
    place = np.tile(np.arange(w), len(p))
    columns = [np.repeat(p, w), np.repeat(e, w), place, totals[p, e].ravel(), np.repeat(rows[p, e], w)]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "place", "total", "n"])


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, _, w = books.shape
    for b, x in _parts(batches, parts * w, parts):
        found = [nearest(x[:, p], books[p]) for p in range(parts)]
        code = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
        text = [r.tobytes().hex() for r in code]
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(text, pa.string()), pa.array(sum(f[1] for f in found), pa.int64())], ["vec_id", "label", "code", "error"])


def compress(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(codes, books): codes has vec_id, label, code (hex, two digits a part), error, label_error; books is int64 by part, entry and place.

    Components become floor(scale * x), vectors are cut into equal parts, and each
    part has a codebook that starts as that part of the rows with the smallest
    ids. A round assigns every part to its nearest entry and makes each used entry the
    floor of its parts' mean. What a round moves is a sum for each used entry and task;
    what the driver reads and broadcasts is the codebooks, entries x components
    numbers, whatever the input. Every round reads a table of integers in the shared folder.

    Dropped: null vectors, and such as hold a null, NaN or infinite component.
    Vectors of other lengths than the longest, or lengths that ``parts`` does not
    divide, are as if they ended in zeros. Null ids sort last, rows of one id by their
    vectors; repeated rows count each time. Rows of a null label are one label. Fewer
    rows than ``entries`` make smaller codebooks; an empty table gives no codes and empty books. A
    part of equally near entries takes the first. label_error is null where it exceeds a long.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits: 256 entries at most")
    kept = save(integers(rows, vec_col, scale, rows[id_col].alias("vec_id"), rows[label_col].alias("label")), "vector-integers")
    size = -(-max(width(kept), 1) // parts) * parts
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    books = np.ascontiguousarray(matrix(seeds.column(0), size).reshape(-1, parts, size // parts).transpose(1, 0, 2)) if len(seeds) else np.zeros((parts, 0, size // parts), np.int64)
    if not len(seeds):
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), books
    for _ in range(rounds):
        now = books
        sums = kept.select("vector").mapInArrow(lambda it, now=now: _sums(it, now), "part long, entry long, place long, total long, n long")
        for r in sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n")).toLocalIterator():
            books = books.copy() if books is now else books
            books[r.part, r.entry, r.place] = int(r.total) // r.n
    of = kept.schema
    last = books
    coded = save(kept.mapInArrow(lambda it: _codes(it, last), f"vec_id {of['vec_id'].dataType.simpleString()}, label {of['label'].dataType.simpleString()}, code string, error long"), "vector-codes")
    labels = save(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "vector-labels").withColumnRenamed("label", "of")
    return coded.join(bounded(labels), F.col("label").eqNullSafe(F.col("of")), "left").drop("of"), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
