"""Vector codes and exact search against plain versions, over nulls, non-finite components, ties, repeated rows and uneven lengths."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywell.llm import top_search
from tallywell.llm.top_search import search
from tallywell.llm.vector_codes import books_digest, compress, nearest

COLUMNS = "vec_id long, embedding array<double>, label int, code string, error string, vector string, asked int, query int, score int, part int, of int"


def rows(n: int = 700, size: int = 32, seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    point = lambda: [round(r.gauss(0, 0.3), 3) for _ in range(size)]
    same = point()
    out = [(i, same if i % 3 == 1 else point(), None if i % 7 == 0 else i % 5) for i in range(n)]
    out += [(2000, None, 1), (2020, [0.1, None] + [0.0] * (size - 2), 1), (2040, [math.nan] * size, 2), (2060, [math.inf] + [0.0] * (size - 1), 3), (None, same, 4)]
    out += [out[40], out[40], (60, point(), 2), (3, point(), 2), (80, [0.0] * size, 0), (2080, [1e9] + [0.0] * (size - 1), 0), (2081, [-1.5] * (size - 5), 1), (2100, [], 1)]
    return [x + ("a", "b", "c", 1, 2, 3, 4, 5) for x in out]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), COLUMNS).repartition(6).cache()


def kept(rows, scale):
    """(id, vector, label) as integers, ends filled with zeros; what exceeds the limit stops at it."""
    fine = [(i, v, b) for i, v, b, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    most = max(len(v) for _, v, _ in fine)
    limit = 134217728
    return [(i, [max(-limit, min(limit, math.floor(scale * x))) for x in v] + [0] * (most - len(v)), b) for i, v, b in fine]


def by_id(i):
    return (i is None, i or 0)


def test_search_equals_all_pairs(spark, table):
    k = kept(rows(), 64)
    want = []
    for q, v in {(i, tuple(v)) for i, v, _ in k if i is not None and i % 20 == 0}:
        scores = sorted(((sum(a * b for a, b in zip(v, w)), i) for i, w, _ in k if i != q), key=lambda s: (-s[0], by_id(s[1])))
        want += [(q, n + 1, i, s) for n, (s, i) in enumerate(scores[:20])]
    order = lambda r: (r[0], r[1], -r[3], by_id(r[2]))
    got = search(table, F.col("vec_id") % 20 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    assert any(math.log2(abs(w[3]) + 1) > 24 for w in want)


def test_search_in_blocks_and_few_rows(spark, table, monkeypatch):
    whole = sorted(map(tuple, search(table.filter("vec_id < 500"), F.col("vec_id") % 20 == 0, k=7).collect()))
    monkeypatch.setattr(top_search, "QUERY_BLOCK", 8)
    for lists in (1, 3, 64):
        assert sorted(map(tuple, search(table.filter("vec_id < 500").repartition(3), F.col("vec_id") % 20 == 0, k=7, lists=lists).collect())) == whole
    few = search(table.filter("vec_id IN (0, 1, 2)"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 2 and {r.rank for r in few} == {1, 2}
    assert search(table.filter("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0
    assert search(table.filter("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_scores_of_any_size_are_exact(spark):
    r = random.Random(1)
    big = [(i, [float(r.randint(-(10**6), 10**6)) for _ in range(64)]) for i in range(60)]
    got = {(x.query_id, x.vec_id): x.score for x in search(spark.createDataFrame(big, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()}
    v = {i: [int(64 * x) for x in e] for i, e in big}
    assert len(got) == 60 and all(s == sum(a * b for a, b in zip(v[q], v[c])) for (q, c), s in got.items()) and max(map(abs, got.values())) > 2**53


def test_a_cutoff_lets_go_of_most_rows():
    """The third phase measures few rows: the cutoff and the bounds are at work."""
    r = np.random.default_rng(5)
    x = r.integers(-60, 60, (4000, 32))
    x[:40] *= 3
    block = top_search._Block(np.zeros(0, np.int64), x[:40] // 3, 4)
    scores = x[:40] // 3 @ x.T
    cut = np.sort(scores, axis=1)[:, -20]
    partial = block.scores(x)
    share = -(-cut // 4)
    collected = np.zeros(scores.shape, bool)
    for p in partial:
        collected |= p >= share[:, None]
    assert (sum(partial) == scores).all() and (collected | (scores < cut[:, None])).all() and collected.mean() < 0.5


@pytest.mark.parametrize("width", [1, 2, 3, 4, 9, 16])
def test_nearest_is_exact(width):
    r = np.random.default_rng(width)
    for spread in (3, 500, 2**27):
        x, c = r.integers(-spread, spread, (900, width)), r.integers(-spread, spread, (40, width))
        c[7], x[5], x[6] = c[3], c[3], c[39]
        entry, d = nearest(x, c)
        exact = ((x[:, None] - c) ** 2).sum(axis=2)
        assert (entry == exact.argmin(axis=1)).all() and (d == exact.min(axis=1)).all()


def plain_codes(rows, parts=16, entries=64, rounds=2):
    k = sorted(kept(rows, 256), key=lambda t: (by_id(t[0]), t[1]))
    w = len(k[0][1]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for _, v, _ in k]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((far(v, e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        codes = [[near(c[p], p)[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in set(c[p] for c in codes):
                own = [cut[i][p] for i, c in enumerate(codes) if c[p] == e]
                books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    out, labels = [], {}
    for (i, _, b), c in zip(k, cut):
        found = [near(c[p], p) for p in range(parts)]
        out.append((i, b, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
        labels[b] = labels.get(b, 0) + out[-1][3]
    return [(*o, labels[o[1]]) for o in out], books


def test_codes_equal_plain_ones(spark, table):
    small = [x for x in rows(260) if not x[1] or max(abs(y or 0) for y in x[1]) < 100]
    want, books = plain_codes(small)
    codes, got = compress(spark.createDataFrame(small, COLUMNS).repartition(5))
    assert codes.columns == ["vec_id", "label", "code", "error", "label_error"]
    key = lambda r: (by_id(r[0]), r[2])
    assert sorted(map(tuple, codes.collect()), key=key) == sorted(want, key=key)
    assert got.tolist() == books
    assert len({books_digest(compress(table.filter("vec_id < 300").repartition(n))[1]) for n in (1, 7)}) == 1


def test_codes_of_few_rows_and_of_none(spark, table):
    few = rows(60, 18)[:30]
    want, books = plain_codes([(i, v + [0.0] * 14, b) for i, v, b, *_ in few])
    codes, got = compress(spark.createDataFrame(few, COLUMNS))
    assert got.shape == (16, 30, 2) and got.tolist() == books and sorted(map(tuple, codes.collect())) == sorted(want)
    codes, got = compress(table.filter("embedding IS NULL"))
    assert codes.columns == ["vec_id", "label", "code", "error", "label_error"] and codes.count() == 0 and got.shape[1] == 0
