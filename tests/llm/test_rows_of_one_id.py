"""Substring dedup where many rows, of different texts, have the same id: each keeps what a plain version keeps."""

import collections
import random

from tallywell.llm.substring_dedup import remove_repeats


def test_each_row_has_its_own_marks(spark):
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(500)]
    passages = [[r.choice(vocab) for _ in range(22)] for _ in range(25)]
    rows = []
    for i in range(300):
        w = [r.choice(vocab) for _ in range(r.randint(0, 12))] + r.choice(passages)[r.randint(0, 5) :] + [r.choice(vocab) for _ in range(r.randint(0, 12))]
        rows.append((1 + i % 3, " ".join(w)))
    rows += [rows[7], rows[8], (2, None), (None, rows[0][1]), (None, None)]
    least: dict = {}
    for i, t in rows:
        w = (t or "").split()
        for a in range(len(w) - 12 if i is not None else 0):
            k = tuple(w[a : a + 13])
            least[k] = min(least.get(k, i), i)
    want = collections.Counter()
    for i, t in rows:
        w = (t or "").split()
        gone = set()
        for a in range(len(w) - 12 if i is not None else 0):
            if least[tuple(w[a : a + 13])] < i:
                gone |= set(range(a, a + 13))
        want[(i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))] += 1
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "n_words", "n_removed", "text").collect()
    assert collections.Counter(map(tuple, got)) == want and any(k[2] for k in want)


def test_bitmaps_by_blocks_are_those_of_all_pairs():
    """What may link is what a plain comparison of all pairs says."""
    import numpy as np

    from tallywell.llm.prefix_tree import may_link, signature

    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 62, 60, dtype=np.uint64)
    sets = [np.unique(np.r_[base[: r.integers(0, 60)], r.integers(0, 1 << 62, r.integers(1, 60), dtype=np.uint64)]) for _ in range(700)]
    sizes, maps = np.array([len(s) for s in sets]), [np.frombuffer(signature(s), np.uint64) for s in sets]
    width = min(map(len, maps))
    maps = [np.bitwise_or.reduce(m.reshape(-1, width), 0) for m in maps]
    ones = lambda x: int(np.bitwise_count(x).sum())
    want = [any(i != j and 7 * min(sizes[i] - ones(maps[i] & ~maps[j]), sizes[j] - ones(maps[j] & ~maps[i])) >= 3 * (sizes[i] + sizes[j]) for j in range(700)) for i in range(700)]
    assert may_link(sizes, [signature(s) for s in sets]).tolist() == want and 0 < sum(want) < 700
