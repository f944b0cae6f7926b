"""The Jaccard join moves prefixes, bitmaps and texts in turns, none of which holds more than its share, with the same result."""

from tallywell.llm import prefix_tree


def test_turns_hold_their_share(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([f"d{i}", *words, f"e{i % 10}", f"f{i % 25}"])) for i in range(40)] + [(100 + i, " ".join(f"x{i}y{j}" for j in range(30))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, prefix_tree.join_components(docs, max_listed=4).collect()))
    saved, plain = {}, prefix_tree.save

    def save(df, name):
        saved.setdefault(name, []).append(plain(df, name))
        return saved[name][-1]

    monkeypatch.setattr(prefix_tree, "save", save)
    for name in ("_MARKS_AT_ONCE", "_TEXTS_AT_ONCE"):
        monkeypatch.setattr(prefix_tree, name, 0.1)
    assert sorted(map(tuple, prefix_tree.join_components(docs, max_listed=4).collect())) == whole
    assert [c for _, _, c in whole] == [0] * 40 + list(range(100, 120))
    seen = [{r.gram for r in t.filter("gram IS NOT NULL").select("gram").distinct().collect()} for t in saved["join-met"]]
    assert len(seen) == prefix_tree._PASSES and sum(map(len, seen)) == len(set().union(*seen)) > 0
    assert len(saved["join-asked"]) > 1 and len(saved["join-links"]) > 1
