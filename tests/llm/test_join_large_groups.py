"""A group of sets too large for one task is narrowed by its bitmaps, part by part, before any text of it moves."""

import numpy as np

from tallywell.llm import prefix_tree


def texts():
    """300 texts that share a passage and little else, so that none links, but for six pairs of near copies."""
    passage = " ".join(f"p{i}" for i in range(30))
    own = [[f"d{i}w{j}" for j in range(30)] for i in range(300)]
    rows = [(i, f"{passage} {' '.join(w)}") for i, w in enumerate(own)]
    return rows + [(1000 + i, f"{passage} {' '.join(own[i])} more{i}") for i in range(0, 300, 50)]


def test_only_sets_that_may_link_are_in_blocks(spark, monkeypatch):
    saved, plain = {}, prefix_tree.save

    def save(df, name):
        saved.setdefault(name, []).append(plain(df, name))
        return saved[name][-1]

    monkeypatch.setattr(prefix_tree, "save", save)
    docs = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in prefix_tree.join_components(docs, max_listed=4, max_frequent=0, block_grams=200).collect()}
    assert got == {i: i % 1000 if i >= 1000 else i for i, _ in texts()}
    wide = {r.name for t in saved["join-wide"] for r in t.select("name").collect()}
    members = {r.name for t in saved["join-members"] for r in t.select("name").collect()}
    assert len(wide) > 250 and len(members) <= 24  # bitmaps let few pass that don't link
    assert max(r.parts for t in saved["join-wide-sums"] for r in t.collect()) > 5 and len(saved["join-visits"]) > 0


def test_pairs_of_few_sets_are_narrowed_too(spark, monkeypatch):
    """Two texts that share half of their shingles meet as a pair; no text of theirs moves."""
    saved, plain = [], prefix_tree.save
    monkeypatch.setattr(prefix_tree, "save", lambda df, name: saved.append((name, plain(df, name))) or saved[-1][1])
    rows = []
    for k in range(0, 60, 2):
        same = " ".join(f"k{k}s{i}" for i in range(60))
        rows += [(k + x, f"{same} {' '.join(f'k{k}x{x}y{i}' for i in range(50))}") for x in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in prefix_tree.join_components(docs).collect()} == {(i, i) for i, _ in rows}
    tables = dict(saved)
    assert tables["join-wide"].count() > 20 and tables["join-members"].count() == 0


def test_may_meet_loses_no_pair():
    r = np.random.default_rng(5)
    base = [r.integers(0, 1 << 62, int(r.integers(150, 300)), np.uint64) for _ in range(40)]
    change = lambda v, k: np.unique(np.r_[v[k:], r.integers(0, 1 << 62, k, np.uint64)])
    guests = [change(base[i % 40], int(len(base[i % 40]) * (i % 4) / 12)) for i in range(300)]
    hosts = [np.unique(base[i]) for i in range(20)] + [r.integers(0, 1 << 62, int(r.integers(150, 300)), np.uint64) for _ in range(400)]
    of, marks = (lambda x: np.array([len(v) for v in x])), (lambda x: [prefix_tree.signature(v) for v in x])
    got = prefix_tree.may_meet(of(guests), marks(guests), of(hosts), marks(hosts))
    links = lambda x, y: 7 * len(np.intersect1d(x, y)) >= 3 * (len(x) + len(y))
    want = np.array([any(links(x, y) for y in hosts) for x in guests])
    far = np.arange(300) % 40 >= 20  # no host resembles these
    assert want.sum() > 50 and got[want].all() and got[far].mean() < 0.05
    assert not prefix_tree.may_meet(of(guests), marks(guests), of([]), []).any() and not len(prefix_tree.may_meet(of([]), [], of(hosts), marks(hosts)))
