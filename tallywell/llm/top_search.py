"""Exact top-k by inner product: the three phases of a uniform threshold, over blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import fresh_path, save
from .vectors import integers, matrix, width

#: Queries that one pass over the table answers; fewer of very wide vectors, so that a broadcast block stays under 32 MB.
QUERY_BLOCK = 4096
_BLOCK_BYTES = 32 << 20
_ROWS = 1024
_NONE = -(2**62)


def _segments(size: int, lists: int) -> list[slice]:
    cuts = np.linspace(0, size, min(lists, max(size, 1)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]


class _Block:
    """A block of queries, and their partial scores over each segment of the components."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lists: int):
        self.order = np.argsort(ids)
        self.ids, self.vectors, self.cuts = ids[self.order], vectors, _segments(vectors.shape[1], lists)
        self.most = int(np.abs(vectors).max(initial=0))

    def scores(self, x: np.ndarray) -> list[np.ndarray]:
        """For each segment a matrix queries x rows, exact: of floats while they hold such integers."""
        bound = self.most * int(np.abs(x).max(initial=0)) * max(x.shape[1], 1)
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
        q, v = self.vectors.astype(kind), x.astype(kind)
        return [q[:, c] @ v[:, c].T for c in self.cuts]

    def own(self, ids: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the rows that have a query's id."""
        a, b = np.searchsorted(self.ids, ids), np.searchsorted(self.ids, ids, "right")
        n = np.where(null, 0, b - a)
        row = np.repeat(np.arange(len(ids)), n)
        return self.order[a[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)], row


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, which are null, vectors) in pieces that grow to _ROWS: the first ones fill the lists, cheaply."""
    n = 64
    for b in batches:
        a = 0
        while a < b.num_rows:
            part = b.slice(a, n)
            ids = part.column("vec_id")
            yield ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), matrix(part.column("vector"), size)
            a, n = a + n, min(2 * n, _ROWS)


def _merge(best: np.ndarray, query: np.ndarray, value: np.ndarray) -> None:
    """Into best (queries x k, the k greatest of each in no order), more values, sorted by query."""
    if not len(query):
        return
    rows, first, n = np.unique(query, return_index=True, return_counts=True)
    more = np.full((len(rows), n.max()), _NONE, np.int64)
    more[np.repeat(np.arange(len(rows)), n), np.arange(len(query)) - np.repeat(first, n)] = value
    k = best.shape[1]
    best[rows] = np.partition(np.concatenate([best[rows], more], axis=1), -k, axis=1)[:, -k:]


def _gather(batches: Iterator[pa.RecordBatch], block: _Block, k: int) -> Iterator[pa.RecordBatch]:
    """Phase 1, in one shard: each segment's list of the k greatest partial scores of a query; of what enters a list, the sums over all segments.

    All segments of a row lie in its shard, so these sums are whole scores, and the k greatest go out.
    """
    n = len(block.vectors)
    lists = [np.full((n, k), _NONE, np.int64) for _ in block.cuts]
    best = np.full((n, k), _NONE, np.int64)
    for ids, null, x in _pieces(batches, block.vectors.shape[1]):
        partial, own = block.scores(x), block.own(ids, null)
        entered = np.zeros(partial[0].shape, bool)
        for have, p in zip(lists, partial):
            new = p > have.min(axis=1)[:, None].astype(p.dtype)
            new[own] = False
            entered |= new
            q, r = np.nonzero(new)
            _merge(have, q, p[q, r].astype(np.int64))
        q, r = np.nonzero(entered)
        total = sum(p[q, r].astype(np.int64) for p in partial)
        high = total > best.min(axis=1)[q]
        _merge(best, q[high], total[high])
    q, r = np.nonzero(best > _NONE)
    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(best[q, r], pa.int64())], ["query", "score"])


def _resolve(batches: Iterator[pa.RecordBatch], block: _Block, cutoff: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Phases 2 and 3, in one shard.

    A score of at least the cutoff has a partial score of at least an even share of
    it: rows with one are collected. Where a row's others are below the share, so is
    what they can add; rows that then can't reach the bar go, and the rest get their
    exact scores. The bar is the cutoff, or the shard's own k-th score once that is higher. Rows at the bar stay.
    """
    share = np.where(cutoff > _NONE, -(-cutoff // len(block.cuts)), _NONE)
    bar = cutoff.copy()
    query, score, name, none = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
    for ids, null, x in _pieces(batches, block.vectors.shape[1]):
        partial = block.scores(x)
        kind = partial[0].dtype
        low = share.astype(kind)[:, None]
        collected, most = np.zeros(partial[0].shape, bool), np.zeros(partial[0].shape, kind)
        for p in partial:
            collected |= p >= low
            most += np.maximum(p, low)
        collected &= most >= bar.astype(kind)[:, None]
        collected[block.own(ids, null)] = False
        q, r = np.nonzero(collected)
        exact = sum(p[q, r].astype(np.int64) for p in partial)
        stay = exact >= bar[q]
        q, r, exact = q[stay], r[stay], exact[stay]
        if not len(q):
            continue
        query, score, name, none = np.r_[query, q], np.r_[score, exact], np.r_[name, ids[r]], np.r_[none, null[r]]
        order = np.lexsort((name, none, -score, query))
        order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < k]
        query, score, name, none = query[order], score[order], name[order], none[order]
        last = np.flatnonzero(np.diff(query, append=-1))
        full = np.diff(last, prepend=-1) == k
        bar[query[last[full]]] = np.maximum(bar[query[last[full]]], score[last[full]])
    yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(name, pa.int64(), mask=none), pa.array(score, pa.int64())], ["query", "vec_id", "score"])


def _best(rows: DataFrame, k: int, *ties: Column) -> DataFrame:
    """The k highest scores of each query, with rank; each task keeps k of its own before they are dealt by query."""
    w = W.partitionBy("query").orderBy(F.col("score").desc(), *ties)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, lists: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, the k other rows with the highest integer inner products.

    Components become floor(scale * x). A row's score is the sum of its partial
    scores over ``lists`` segments of the components; a shard (a partition of the
    table) has a list for each query and segment. Queries go through in blocks of
    at most QUERY_BLOCK, dealt by a hash, each broadcast by itself (32 MB at most):

    1. every shard gathers the k greatest of each of its lists, and sends the k
       greatest sums of what is in them; the k-th greatest of all is the cutoff, which the true k-th score can't be below;
    2. the cutoffs of the block are broadcast; every shard collects rows with a
       partial score of at least an even share of the cutoff, which all rows of the answer have, and lets go of
       those whose other segments, at less than a share each, can't lift them to it;
    3. the remaining ones get exact scores, and the k best of each shard meet.

    A task holds k entries a query and a piece of 1,024 rows, k rows a query and
    shard move, and all steps are functions of their input, so a lost executor costs its tasks; each block's answer is written to the shared folder.

    Ties go to the smaller id; null ids come last, can be found, and are no
    queries. Vectors that are null or hold a null, NaN or infinite component take
    no part; shorter ones count as ending in zeros. "Other" means of another id:
    repeated rows are found once each, and equal query rows are one query; query
    rows of one id and different vectors each have their own ranks. With fewer than k others all are returned; an empty table gives no rows.
    """
    spark = rows.sparkSession
    asked = F.coalesce(is_query, F.lit(False)) & rows[id_col].isNotNull()
    kept = save(integers(rows, vec_col, scale, rows[id_col].cast("long").alias("vec_id"), asked.alias("asked")), "vector-integers")
    size = max(width(kept), 1)
    most = max(1, min(QUERY_BLOCK, _BLOCK_BYTES // (8 * size)))
    queries = kept.filter("asked").select("vec_id", "vector").distinct()
    blocks = -(-queries.count() // (most - most // 8))
    asked_of = save(queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(max(blocks, 1)))).repartition(max(1, min(blocks, 200)), "block"), "queries")
    paths = []
    for b in range(blocks):
        now = asked_of.filter(F.col("block") == b).orderBy("vec_id", "vector").toArrow()
        if not len(now):
            continue
        ids = now.column("vec_id").to_numpy()
        block = spark.sparkContext.broadcast(_Block(ids, matrix(now.column("vector"), size), lists))
        sums = kept.select("vec_id", "vector").mapInArrow(lambda it, block=block: _gather(it, block.value, k), "query int, score long")
        cut = np.full(len(ids), _NONE, np.int64)
        ends = _best(sums, k).filter(F.col("rank") == k).toArrow()
        cut[ends.column("query").to_numpy()] = ends.column("score").to_numpy()
        cutoff = spark.sparkContext.broadcast(cut)
        rest = kept.select("vec_id", "vector").mapInArrow(lambda it, block=block, cutoff=cutoff: _resolve(it, block.value, cutoff.value, k), "query int, vec_id long, score long")
        names = spark.createDataFrame(pa.table({"query": pa.array(range(len(ids)), pa.int32()), "query_id": pa.array(ids, pa.int64())}))
        answer = _best(rest, k, F.col("vec_id").asc_nulls_last()).join(F.broadcast(names), "query").select("query_id", "rank", "vec_id", "score")
        paths.append(fresh_path(spark, "top"))
        answer.write.parquet(paths[-1])
        block.destroy()
        cutoff.destroy()
    schema = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
