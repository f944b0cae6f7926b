"""mixed_documents against a brute-force mix: copies of each document, and their order."""

import collections
import hashlib
import math

from tallywell.llm import mixing


def test_copies_and_order(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), [None, "a", "b"][i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    targets = {r.source: r.target for r in mixing.source_targets(frame, (5, 2, 1), 1.5, 2.0).collect()}
    want = []
    for s, a in (("a", 0.5), ("b", 1.5), (None, 1.0)):
        at, goal, whole = 0, math.floor(targets[s]), sizes[s]
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            n = len(t.split())
            taken = sum(c * whole + at + k < goal for c in range(3) for k in range(n))
            for c in range(math.floor(taken / n + 0.5)):
                share, lo, hi = min(1.0, (c * whole + at) / targets[s]), 0.0, 1.0
                for _ in range(60):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if a * mid + (1 - a) * mid * mid < share else (lo, mid)
                want.append((round(lo, 9), hashlib.md5(str(i).encode()).hexdigest(), i))
            at += n
    got = [r.doc_id for r in mixing.mixed_documents(docs).select("doc_id").collect()]
    assert got == [i for *_, i in sorted(want)]
    assert len(got) > len(set(got))


def test_columns_of_any_type(spark):
    """Maps, arrays and structs stay as they are, and rows that differ in them alone are rows of their own."""
    rows = [(i, "one two three four", "s", {"k": str(i % 2)}, [i], (i, {"a": [1]})) for i in range(6)] + [(0, "one two three four", "s", {"k": "9"}, [0], (0, None)), (7, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tags map<string,string>, list array<int>, both struct<n:int,m:map<string,array<int>>>")
    got = mixing.mixed_documents(docs)
    assert got.schema == docs.schema
    assert {repr(r) for r in got.collect()} <= {repr(r) for r in docs.collect()} and got.count() > 6
