"""The pipeline's stages on the smallest tables, each on what the one before kept."""

import os

import pytest

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_stages(spark):
    import corpus_pipeline as p
    from tallywell.llm.decontaminate import find_leaks
    from tallywell.llm.prefix_tree import join_components
    from tallywell.llm.session import save
    from tallywell.llm.toxicity import score_toxicity, train

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    kept, columns = [docs], docs.columns
    for name, stage in p.STAGES[:-1]:
        kept.append(save(stage(spark, kept[-1], DIR), f"test-{name}"))
        assert kept[-1].columns == columns
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    assert ids(kept[1]) == ids(score_toxicity(docs, train(docs, labels)).filter("predicted = 0"))
    assert ids(kept[2]) == ids(join_components(kept[1]).filter("component_id = doc_id"))
    leaks = {r.doc_id for r in find_leaks(kept[2], spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()}
    assert ids(kept[3]) == [i for i in ids(kept[2]) if i not in leaks]
    assert set(ids(kept[4])) <= set(ids(kept[3]))
    out = p.run(spark, DIR)
    assert ids(out) == ids(kept[4])
    assert set(out.columns) == {"doc_id", "start", "n_tokens", "ids_crc32"}


def test_stages_on_odd_rows(spark, docs, rows, none, tmp_path):
    """Nulls, blanks, repeated rows, long texts and clashing columns go through all stages, each held against brute force; so does an empty table."""
    import collections
    import zlib

    import corpus_pipeline as p
    import numpy as np
    from test_llm_operators import LOW, brute_components, library, words

    text = {r[0]: r[1] for r in rows}
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(12, 52)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(words(text[7])[100:140])), (2, None), (3, "Too short")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    taken = lambda d: [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    kept = p.STAGES[0][1](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and set(taken(kept)) <= {(r[0], r[1]) for r in rows}

    before, now = [(r[0], r[1]) for r in rows], p.STAGES[1][1](spark, docs, str(tmp_path))
    first = {(i, c) for i, _, c in brute_components(before)}
    assert now.columns == docs.columns
    assert collections.Counter(taken(now)) == collections.Counter({x for x in before if (x[0], x[0]) in first})

    shingles = lambda t: {tuple(w[i : i + 5]) for w in [words((t or "").translate(LOW))] if w for i in range(max(len(w) - 4, 1))}
    item = shingles(" ".join(words(text[7])[100:140]))
    now = p.STAGES[2][1](spark, docs, str(tmp_path))
    assert now.columns == docs.columns
    assert collections.Counter(taken(now)) == collections.Counter(x for x in before if len(item & shingles(x[1])) < 0.75 * len(item)) and (7, text[7]) not in taken(now)

    now = p.STAGES[3][1](spark, docs, str(tmp_path))
    assert now.columns == docs.columns
    copies, whole = collections.Counter(taken(now)), collections.Counter(before)
    assert all(words(t) and n <= 2 * whole[i, t] for (i, t), n in copies.items())
    sizes, got = collections.Counter(), collections.Counter()
    source = {(r[0], r[1]): r[3] for r in rows}
    for x in before:
        sizes[source[x]] += len(words(x[1]))
    for x, n in copies.items():
        got[source[x]] += n * len(words(x[1]))
    assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) <= sum(max(len(words(t)) for _, t in before) for _ in sizes)

    t, out = library(), p.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    ids = lambda s: [*t.encode(s or "", add_special_tokens=False).ids, 0]
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == collections.Counter((i, len(ids(s)), zlib.crc32(np.array(ids(s), "<u4").tobytes())) for i, s in before)
    for _, stage in p.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
