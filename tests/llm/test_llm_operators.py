"""Each operator against a brute-force version over nulls, blanks, copies, long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallywell.llm import lm_score, mixing, queries, secrets, token_files, toxicity
from tallywell.llm.decontaminate import drop_leaks, find_leaks
from tallywell.llm.exact_dedup import exact_dedup
from tallywell.llm.prefix_tree import Tree, join_components, keep_one
from tallywell.llm.session import fresh_path
from tallywell.llm.substring_dedup import remove_repeats
from tallywell.llm.token_counts import count_tokens
from tallywell.llm.words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall(t or "")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer())


def test_words_are_those_of_the_pattern(rows):
    texts = [r[1] for r in rows]
    w = Words(pa.array(texts))
    got = [[w.data[a:b].tobytes().decode() for a, b in zip(w.start[f : f + n], w.end[f : f + n])] for f, n in zip(w.first, w.count)]
    assert got == [words(t) for t in texts]
    flat = [x for t in got for x in t]
    assert len(set(w.hashes().tolist())) == len(set(flat))


def test_token_counts(docs, rows, none):
    t = library()
    got = collections.Counter(map(tuple, count_tokens(docs, queries.tokenizer()).collect()))
    want = collections.Counter()
    for r in rows:
        n = len(t.encode(r[1] or "", add_special_tokens=False).ids)
        want[(r[0], len((r[1] or "").encode()), n, n > 512)] += 1
    assert got == want
    assert collections.Counter(map(tuple, count_tokens(docs, queries.tokenizer(), sample_docs=3, table_entries=2, cache_entries=5).collect())) == want
    assert count_tokens(none, queries.tokenizer()).count() == 0


def test_plain_texts_are_cut_as_the_library_does():
    """Strings of all kinds of plain characters, and of some others, against the library; and most of them take the fast way."""
    import random

    from tallywell.llm import bpe

    r, t = random.Random(4), library()
    kinds = ["abcXYZ", "éßÀø", "αβγΩ", "привет", "אבג", "ابت", "かなカー", "漢字中", "한국어", "0123456789", " \n\t\r\u3000\xa0", "'s't're'll", ".,;:!?-_#()[]{}", "…–—“”€→─☀", "😀👍\U0001f3fd\u200d\ufe0f、。！", "²¾Ⅷ٣", "\u0301\u0bcd", "\x00\x1c\x85"]
    texts = ["".join(r.choice(k) for _ in range(r.randint(1, 12)) for k in [r.choice(kinds[: 15 if i % 4 else 18])] for _ in range(r.randint(1, 4))) for i in range(3000)]
    want = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    pieces = [p for cut in bpe.Encoder(queries.tokenizer()).cut(texts[:1500]) for p in cut]
    encoder = bpe.Encoder(queries.tokenizer(), bpe.frequent_lengths(queries.tokenizer(), pieces), 500)
    assert encoder.lengths(texts) == want and [len(x) for x in encoder.ids(texts)] == want
    assert sum(map(encoder._plain, texts)) > 2000


def test_exact_dedup(docs, rows, none):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[hashlib.sha256((r[1] or "").translate(LOW).encode()).hexdigest()].append(r[0])
    want = collections.Counter()
    for h, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, keep, len(ids), i == keep, h)] += 1
    assert collections.Counter(map(tuple, exact_dedup(docs, digest_all=True).collect())) == want
    part = {r.doc_id: r.sha256 for r in exact_dedup(docs).collect()}
    assert part[10] == part[11] is not None and part[7] is None
    assert exact_dedup(none).count() == 0


def test_mixing(docs, rows, none):
    out = mixing.mix_sources(docs)
    got = out.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted((r[0] is None, r[0] or 0, len(words(r[1]))) for r in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r["size"]
    total = sum(r["size"] for r in got)
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1e-6
    for v in by.values():
        assert v[0].source_size == sum(r["size"] for r in v) and v[0].target <= 2 * v[0].source_size
        assert sum(r.taken for r in v) == int(v[0].target)
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at) and all(0 <= p <= 1 for p in at)
    again = mixing.mix_sources(docs.repartition(3))
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    assert mixing.mix_sources(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    odd = docs.withColumn("__size", F.lit(1)).withColumn("__row", F.lit("r")).withColumn("__doc", F.lit(None).cast("int")).withColumn("position", F.lit(2))
    ids = lambda d: [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    assert ids(mixing.mixed_documents(odd)) == ids(mixed) and mixing.mixed_documents(odd).columns == odd.columns
    assert collections.Counter(map(str, mixing.mix_sources(odd).collect())) == collections.Counter(map(str, got))
    assert mixed.columns == docs.columns and 0 < mixed.count() <= 2 * len(rows) and mixing.mixed_documents(none).count() == 0


def test_targets_fill_up_by_weight(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(s, (5, 2, 1), 1.5, 2.0).collect()}
    assert got["a"] == 20 and abs(got["b"] + got[None] - 2995) < 1e-9 and abs(got["b"] - 1996.6666666666667) < 1e-6
    zero = spark.createDataFrame([("a", 0)], "source string, source_size long")
    assert mixing.source_targets(zero, (5,), 1.5, 2.0).first().target == 0


def brute_components(rows):
    sets = []
    for r in rows:
        w = words((r[1] or "").translate(LOW))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[root(i)] = root(j)
    least: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return collections.Counter((r[0], len(sets[i]), least.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows))


@pytest.mark.parametrize("options", [{}, {"max_listed": 2, "block_grams": 300}, {"max_frequent": 0, "max_listed": 0}, {"max_listed": 3, "block_grams": 10, "salt_rows": 2}])
def test_jaccard_join(docs, rows, none, options):
    assert collections.Counter(map(tuple, join_components(docs, **options).collect())) == brute_components(rows)
    assert join_components(none, **options).count() == 0


def test_jaccard_join_of_chains(spark):
    """Chains of near copies, in which the ends don't link, over parts of a few sets; with copies, and texts that share a passage only."""
    import random

    r = random.Random(8)
    passage, rows = [f"p{i}" for i in range(40)], []
    for c in range(3):
        w = [f"c{c}w{i}" for i in range(60)]
        for step in range(25):
            rows.append((len(rows), " ".join(w)))
            w[(step * 7) % 60] = f"c{c}new{step}"
    rows += [(len(rows) + i, " ".join(passage + [f"x{i}y{r.randrange(9)}" for _ in range(4 + i % 5)])) for i in range(40)]
    rows += [(500 + i, rows[10][1]) for i in range(30)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_components(rows)
    assert len({c for _, _, c in want}) < 60
    for options in ({}, {"max_listed": 2, "block_grams": 250}, {"max_listed": 1, "block_grams": 600, "salt_rows": 3}):
        assert collections.Counter(map(tuple, join_components(docs, **options).collect())) == want


def test_may_link_loses_no_pair():
    from tallywell.llm.prefix_tree import may_link, signature

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 50).astype(np.uint64)
    sets = [np.unique(np.r_[base[rng.random(50) < rng.choice([0.5, 0.9, 0.97])], rng.integers(0, 1 << 62, rng.integers(0, 30)).astype(np.uint64)]) for _ in range(200)]
    sets = [s for s in sets if len(s)]
    got = may_link(np.array([len(s) for s in sets]), [signature(s) for s in sets])
    for i, x in enumerate(sets):
        if any(i != j and 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y)) for j, y in enumerate(sets)):
            assert got[i]
    assert not got.all()


@pytest.mark.parametrize("most", [1, 2, 5])
def test_meeting_of_long_and_short_runs(most):
    from tallywell.llm.prefix_tree import Meeting

    rng = np.random.default_rng(most)
    rows = sorted({(int(g), int(x)) for g, x in zip(rng.zipf(1.4, 3000) % 300, rng.integers(0, 400, 3000))})
    rows = sorted(rows + rows[::7])
    groups = collections.defaultdict(set)
    for g, x in rows:
        groups[g].add(x)
    pairs = {(min(s), x, y) for s in groups.values() if 2 <= len(s) <= most for x in s for y in s if x < y}
    posted = {(g, x) for g, s in groups.items() if len(s) > most for x in s}
    for size in (1, 3, 50, 4000):
        m, out = Meeting(most), []
        for a in range(0, len(rows), size):
            g, x = (np.array(c, np.int64) for c in zip(*rows[a : a + size]))
            out += m.add(g, x, np.full(len(g), 9))
        out += m.add(*[np.zeros(0, np.int64)] * 3, last=True)
        got = [r for b in out for r in b.to_pylist()]
        assert {(r["gram"], r["x"]) for r in got if r["gram"] is not None} == posted
        listed = [(r["pivot"], r["x"], r["y"]) for r in got if r["gram"] is None]
        assert set(listed) == pairs and len(listed) == sum(len(s) * (len(s) - 1) // 2 for s in groups.values() if 2 <= len(s) <= most)


def test_keep_one(docs, rows):
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    want = sorted(i for i, _, c in brute_components(rows) if i == c and i is not None)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want


def test_tree_finds_every_link():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint64)) for _ in range(150)]
    sets.sort(key=len)
    tree, seen = Tree(sets[0][:0]), []
    for i, x in enumerate(sets):
        want = {j for j in seen if 100 * len(np.intersect1d(x, sets[j])) >= 75 * len(np.union1d(x, sets[j]))}
        assert set(tree.links(x, lambda j: False)) == want
        tree.add(x, i)
        seen.append(i)


def test_secrets(docs, rows, none):
    rules = [("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    want = collections.Counter()
    for r in rows:
        f = sorted((m.start(), i, k, m.end()) for i, (k, p, g, n) in enumerate(rules) for m in p.finditer(r[1] or "") if len(m.group(g)) >= n)
        want[(r[0], ",".join(f"{k}:{a}:{b}" for a, _, k, b in f))] += 1
    found = secrets.scan_secrets(docs).collect()
    assert collections.Counter((r.doc_id, ",".join(f"{k}:{a}:{b}" for k, a, b in zip(r.kinds, r.starts, r.ends))) for r in found) == want
    assert any(k[1].count(":") >= 8 for k in want)
    assert secrets.scan_secrets(none).count() == 0


def test_null_paths_do_not_meet_all_their_versions(spark):
    rows = [(None, f"text {i} password = secret{i}") for i in range(2000)] + [(7, f"version {i}") for i in range(500)] + [(None, "the same")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = fresh_path(spark, "ledger-null")
    found = secrets.scan_secrets(docs, path)
    assert found.count() == len(rows) and found.filter("size(kinds) = 1").count() == 2000
    assert spark.read.parquet(path).count() == len(rows)  # each row is scanned once; repeats of both path and text as often as they are there


def test_ledger_scans_only_what_is_new(spark, docs):
    path = fresh_path(spark, "ledger-test")
    first = secrets.scan_secrets(docs, path).collect()
    n = spark.read.parquet(path).count()
    blobs = docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert spark.read.parquet(path).select("blob").distinct().count() == blobs and blobs <= n <= blobs + 2  # two rows repeat path and text
    assert sorted(map(str, secrets.scan_secrets(docs, path).collect())) == sorted(map(str, first))
    assert spark.read.parquet(path).count() == n
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(10, "a later version: password = abcdef1")], "doc_id long, text string"))
    assert any(r.kinds == ["assign"] and r.doc_id == 10 for r in secrets.scan_secrets(more, path).collect())
    assert spark.read.parquet(path).count() == n + 1
    secrets.scan_secrets(docs, path, rule_version=2).collect()
    assert spark.read.parquet(path).count() == 2 * n + 1


def test_token_files(spark, docs, rows, none):
    t, path = library(), fresh_path(spark, "token-files-test")
    token_files.write_token_files(docs, path, queries.tokenizer(), shard_bytes=2000)
    got = sorted(map(tuple, token_files.describe_token_files(spark, path).collect()), key=lambda r: r[1])
    start = 0
    for g in got:
        assert g[1] == start
        start += g[2]
    enc = lambda s: [*t.encode(s or "", add_special_tokens=False).ids, 0]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert collections.Counter((g[0], g[2], g[3]) for g in got) == collections.Counter((r[0], len(enc(r[1])), crc(enc(r[1]))) for r in rows)
    ids = [g[0] for g in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    for i in (0, 7, 9, 20):
        assert token_files.read_document(spark, path, i) == enc(next(r[1] for r in rows if r[0] == i))
    assert token_files.read_document(spark, path, None) == enc(next(r[1] for r in rows if r[0] is None))
    assert token_files.read_document(spark, path, 10_000) is None and token_files.read_document(spark, path, "None") is None
    assert spark.read.parquet(f"{path}/shards").count() > 5
    empty = fresh_path(spark, "token-files-empty")
    token_files.write_token_files(none, empty, queries.tokenizer())
    assert token_files.describe_token_files(spark, empty).count() == 0 and token_files.read_document(spark, empty, 1) is None


def test_index_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BUCKET_KEYS", 4)
    monkeypatch.setattr(token_files, "DIR_BUCKETS", 2)
    docs = spark.createDataFrame([(f"key-{i}", "a b c"[: i % 6]) for i in range(200)], "doc_id string, text string").repartition(3)
    path = fresh_path(spark, "token-files-many")
    token_files.write_token_files(docs, path, queries.tokenizer(), shard_bytes=60)
    assert spark.read.parquet(f"{path}/index").count() > 20
    t = library()
    for i in (0, 17, 99, 199):
        assert token_files.read_document(spark, path, f"key-{i}") == [*t.encode("a b c"[: i % 6], add_special_tokens=False).ids, 0]
    assert token_files.read_document(spark, path, "key-200") is None


def test_long_texts_are_encoded_in_parts():
    from tallywell.llm import bpe

    text = " ".join(f"word{i}, and  more\n" for i in range(3000)) + "日本 ²"
    assert len(bpe.segments(text, 500)) > 20 and "".join(bpe.segments(text, 500)) == text
    e = bpe.Encoder(queries.tokenizer())
    assert np.concatenate([e._ids(x) for x in bpe.segments(text, 500)]).tolist() == library().encode(text, add_special_tokens=False).ids
    assert bpe.segments("x" * 5000, 500) == ["x" * 5000]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 500, 3000])
def test_perfect_hash(n):
    h = token_files.key_hashes(list(range(n)))
    seeds, place = token_files.build_index(h)
    assert sorted(place.tolist()) == list(range(n))
    slots = np.zeros(n, token_files.SLOT)
    slots["fingerprint"][place], slots["offset"][place] = (h >> np.uint64(32)).astype(np.uint32), np.arange(n)
    there, slot = token_files.find(h, seeds.astype("<i8").tobytes(), slots.tobytes())
    assert there.all() and (slot["offset"] == np.arange(n)).all()
    assert not token_files.find(token_files.key_hashes([-5, None]), seeds.astype("<i8").tobytes(), slots.tobytes())[0].any()


def test_decontamination(spark, docs, rows, none):
    text = {r[0]: r[1] for r in rows}
    items = [(1, " ".join(words(text[7])[100:140])), (2, " ".join(words(text[10])[:30] + ["other"] * 3)), (3, "too short"), (4, None), (6, "ONE  two"), (7, "two"), (5, "none of these words is in any text of them all"), (1, " ".join(words(text[7])[100:140]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in find_leaks(docs, bench).collect()}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [words((t or "").translate(LOW))] if w for i in range(max(len(w) - 4, 1))}
    want = {}
    for i, t in items:
        s = shingles(t)
        for r in rows:
            n = len(s & shingles(r[1]))
            if s and n >= 0.75 * len(s):
                want[(r[0], i)] = (len(s), n)
    assert got == want and (7, 1) in want and (10, 2) in want and {(3, 6), (4, 6), (5, 6)} <= set(want) and not any(i in (3, 7) for _, i in want)
    left = drop_leaks(docs, bench)
    assert left.columns == docs.columns
    assert left.count() == len(rows) - sum((r[0] in {d for d, _ in want}) for r in rows)
    assert find_leaks(none, bench).count() == 0 and find_leaks(docs, bench.limit(0)).count() == 0
    assert drop_leaks(docs, bench.limit(0)).count() == len(rows)


def test_substring_dedup(docs, rows, none):
    first: dict = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - 12):
            if r[0] is not None:
                k = tuple(w[i : i + 13])
                first[k] = min(first.get(k, r[0]), r[0])
    want, spans = collections.Counter(), {}
    for r in rows:
        w, gone = words(r[1]), set()
        for i in range(len(w) - 12):
            if r[0] is not None and first[tuple(w[i : i + 13])] < r[0]:
                gone.update(range(i, i + 13))
        want[(r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))] += 1
        spans[r[0]] = gone
    got = remove_repeats(docs).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == want
    assert sum(k[2] for k in want) > 100
    for r in got:
        assert {i for s in r.repeats for i in range(s["first"], s["after"])} == spans[r.doc_id]
        assert all(a["after"] < b["first"] for a, b in zip(r.repeats, r.repeats[1:]))
    assert remove_repeats(none).count() == 0


def test_toxicity(spark, none):
    import random

    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        w = [r.choice(vocab) for _ in range(r.randint(5, 60))] + (["zuxo" + r.choice(vocab)[:2], "zuxoq"] if bad else [])
        r.shuffle(w)
        rows.append((i, " ".join(w), 1))
        labels.append((i, int(bad)))
    rows += [(5000, None, 1), (5001, "", 1), (None, "zuxoq zuxoab", 1), (5002, "x" * 50_000, 1), (5003, " ".join(vocab) * 40, 1)]
    labels += [(5000, None), (None, 1), (5, 0)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, label int"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scorer = toxicity.train(docs, known)
    got = toxicity.score_toxicity(docs, scorer).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    held = [x for x in got if x.held_out and x.doc_id < 900]
    assert sum((x.predicted == 1) == (x.doc_id % 6 == 0) for x in held) / len(held) > 0.97
    kept = toxicity.drop_toxic(docs, scorer)
    assert kept.columns == docs.columns and kept.count() == sum(not x.predicted for x in got)
    flipped = spark.createDataFrame([(i, 1 - t if i is not None and t is not None and zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels], "doc_id long, toxic int")
    same = toxicity.score_toxicity(docs, toxicity.train(docs, flipped)).collect()
    assert {x.doc_id: round(x.score, 6) for x in same} == {x.doc_id: round(x.score, 6) for x in got}  # labels of the held-out fold play no part
    joined = toxicity.train(docs, known, max_entries=0)
    assert joined.held is None
    assert {x.doc_id: round(x.score, 6) for x in toxicity.score_toxicity(docs, joined).collect()} == {x.doc_id: round(x.score, 6) for x in got}
    assert sorted(map(str, toxicity.drop_toxic(docs, joined).collect())) == sorted(map(str, kept.collect()))
    again = docs.withColumn("key", F.lit("k")).withColumn("s0", F.lit(1.0)).union(docs.limit(5).withColumn("key", F.lit("k")).withColumn("s0", F.lit(1.0)))
    assert toxicity.drop_toxic(again, scorer).columns == again.columns and toxicity.score_toxicity(again, scorer).count() == len(rows) + 5
    one = toxicity.train(docs, known.filter("toxic = 0"))
    assert {x.score for x in toxicity.score_toxicity(docs, one).collect()} == {0.0}
    assert toxicity.score_toxicity(none, scorer).count() == 0


def brute_kneser_ney(counts):
    """The log-likelihood ratios of class-conditional Kneser-Ney models, straight from their definition."""
    import math

    classes = [collections.Counter(), collections.Counter()]
    for word, *n in counts:
        for g in toxicity.spell(word):
            for c, k in zip(classes, n):
                c[g] += k
    pooled = {g: classes[0][g] + classes[1][g] for g in set(classes[0]) | set(classes[1])}

    def count(u):
        """Its own count where no more context could be, else how many characters come before it."""
        return pooled[u] if len(u) == toxicity.ORDER or u in pooled else len({g for g in suffixes[len(u) + 1] if g[1:] == u})

    suffixes = {n: {g[-n:] for g in pooled if len(g) >= n} for n in range(1, toxicity.ORDER + 1)}
    known = {u: count(u) for n in suffixes for u in suffixes[n]}

    def p(u):
        if not u:
            return 1 / (len(suffixes[1]) + 1)
        heirs = [v for v in suffixes[len(u)] if v[:-1] == u[:-1]]
        total = sum(known[v] for v in heirs)
        return (known[u] - 0.75) / total + 0.75 * len(heirs) / total * p(u[1:])

    def of_class(c, g):
        heirs = {v: k for v, k in c.items() if v[:-1] == g[:-1] and k}
        total = sum(heirs.values())
        if not total:
            return 1.0, p(g)
        back = sum(min(k, toxicity.DISCOUNT) for k in heirs.values()) / total
        return back, max(c[g] - toxicity.DISCOUNT, 0) / total + back * p(g)

    out = {}
    for g in pooled:
        (back0, p0), (back1, p1) = (of_class(c, g) for c in classes)
        out[g, False], out[g[:-1], True] = math.log(p0 / p1), math.log(back0 / back1)
    return out


def test_kneser_ney(spark):
    import random

    r = random.Random(2)
    counts = [("".join(r.choice("abcé") for _ in range(r.randint(1, 9))), r.choice([0, 1, 9]), r.randint(0, 12)) for _ in range(60)]
    counts = list({w: (w, a, b) for w, a, b in counts if a + b}.values())
    want = brute_kneser_ney(counts)
    grams = toxicity.gram_counts(spark.createDataFrame(counts, "word string, toxic long, ordinary long"))
    got = {(x.key, x.context): x.value for x in toxicity.ratios(grams).collect()}
    assert set(got) <= set(want) and all(abs(got.get(k, 0.0) - v) < 1e-9 for k, v in want.items()) and len(got) > 200
    model = toxicity.Model(toxicity.hash_strings([k for k, _ in got], np.array([c for _, c in got])), np.array(list(got.values())))
    words = [w for w, *_ in counts] + ["zzz", "abcabcabc", "a"]
    for w, s in zip(words, toxicity.text_sums(model, pa.array(words))):
        ratio = sum(want.get((g, False), want.get((g[:-1], True), 0.0)) for g in toxicity.spell(w))
        assert abs(s[0] - ratio) < 1e-3 and s[1] == len(w) + 1 and s[2] == 1


def test_lm_scores(spark, docs, rows, none):
    import random

    r = random.Random(9)
    grammar = [" ".join(x for _ in range(60) for x in ("the", r.choice(["cat", "dog"]), "sat", "on", "a", r.choice(["mat", "hat"]))) for _ in range(150)]
    mixed = []
    for t in grammar[:20]:
        w = t.split()
        r.shuffle(w)
        mixed.append(" ".join(w))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(grammar + mixed)], "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in lm_score.score_documents(df, rounds=3).collect()}
    assert max(got[150 + i].mean_log_prob for i in range(20)) < min(got[i].mean_log_prob for i in range(150))
    odd = lm_score.score_documents(docs).collect()
    assert collections.Counter((x.doc_id, x.n_tokens) for x in odd) == collections.Counter((r[0], len(words(r[1]))) for r in rows)
    assert all((x.mean_log_prob is None) == (x.n_tokens == 0) and x.log_prob <= 0 for x in odd)
    assert lm_score.score_documents(none).count() == 0


def test_lm_gradient():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) * 3 for k, v in lm_score.start_weights().items()}
    ctx, t = rng.integers(0, lm_score.VOCAB, (50, 2 * lm_score.R)), rng.integers(0, lm_score.VOCAB, 50)
    for key, at in (("w", (3, 5)), ("cw", (2, 7)), ("emb", (int(ctx[0, 1]), 4)), ("tb", (int(t[0]) // lm_score.WITHIN, int(t[0]) % lm_score.WITHIN))):
        eps = 1e-5
        lo, hi = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        lo[key][at] -= eps
        hi[key][at] += eps
        slope = -(lm_score.log_probs(hi, ctx, t).mean() - lm_score.log_probs(lo, ctx, t).mean()) / (2 * eps)
        q, g2 = {k: v.copy() for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
        lm_score.train_step(q, g2, ctx, t, 0.1)
        assert abs(np.sqrt(g2[key][at]) - abs(slope)) < 1e-5 + 1e-3 * abs(slope)
