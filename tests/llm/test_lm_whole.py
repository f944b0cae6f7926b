"""The language model's score takes in the whole corpus: every position is trained on once."""

import collections

import numpy as np
import pyarrow as pa
import pytest

from tallywell.llm import lm_score
from tallywell.llm.words import Words


def contexts(w, ids):
    """For each token the ids on both sides, and VOCAB where its document ends."""
    doc, r = w.text_of(), lm_score.R
    near = [*range(-r, 0), *range(1, r + 1)]
    return np.array([[ids[i + d] if 0 <= i + d < len(ids) and doc[i + d] == doc[i] else lm_score.VOCAB for d in near] for i in range(len(ids))])


@pytest.mark.parametrize("piece", [7, 1 << 16])
def test_each_position_is_trained_on_in_one_round(rows, monkeypatch, piece):
    """The contexts and targets of all steps of all rounds are those of all tokens, each once, however documents are cut."""
    monkeypatch.setattr(lm_score, "_PIECE", piece)
    w = Words(pa.array([r[1] for r in rows]))
    ids = lm_score.Vocabulary(np.unique(w.hashes())[::3]).ids(w.hashes())
    edge = np.full(lm_score.R, lm_score.VOCAB, "<u2").tobytes()
    stream = np.frombuffer(edge + edge.join(x for _, _, x in lm_score.pieces(w, ids)) + edge, "<u2")
    got, by_round = collections.Counter(), []
    for turn in range(2):
        seen = [(*c, i) for ctx, t in lm_score.steps(5, stream, 2, turn, 100) for c, i in zip(ctx.tolist(), t.tolist())]
        got.update(seen)
        by_round.append(len(seen))
    assert got == collections.Counter((*c, i) for c, i in zip(contexts(w, ids).tolist(), ids.tolist()))
    assert abs(by_round[0] / sum(by_round) - 0.5) < 0.05


def test_scores_do_not_depend_on_how_rows_are_split(spark, rows, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD", 4000)
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    one, eight = (sorted((r.doc_id is None, r.doc_id or 0, r.log_prob) for r in lm_score.score_documents(df.repartition(n)).collect()) for n in (1, 8))
    assert max(abs(a[2] - b[2]) / max(1, abs(a[2])) for a, b in zip(one, eight)) < 1e-6


def test_a_stream_scores_as_its_contexts_do(rows):
    w = Words(pa.array([r[1] for r in rows[:20]]))
    ids = lm_score.Vocabulary(np.unique(w.hashes())[::3]).ids(w.hashes())
    p = {k: v * 3 for k, v in lm_score.start_weights().items()}
    got = lm_score.stream_log_probs(p, lm_score.shifted(p), *lm_score.stream(w, ids))
    assert np.abs(got - lm_score.log_probs(p, contexts(w, ids), ids)).max() < 1e-4


def test_every_column_of_periodic_text_is_learned(spark):
    text = " ".join("a b c d e f g h".split() * 100)
    df = spark.createDataFrame([(i, text) for i in range(150)], "doc_id long, text string").repartition(3)
    worst = min(r.mean_log_prob for r in lm_score.score_documents(df).collect())
    assert worst > -1, worst


def test_counts_do_not_depend_on_how_rows_are_split(spark):
    texts = [f"once{i} twice{i // 2} common" for i in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = {}
    for t in texts:
        w = Words(pa.array([t]))
        for h in w.hashes().view(np.int64).tolist():
            want[h] = want.get(h, 0) + 1
    for parts in (1, 40):
        assert {r.word: r.n for r in lm_score.word_counts(df.repartition(parts)).collect()} == want


@pytest.mark.parametrize("table_words", [0, 700, 200_000])
def test_shared_words_score_by_their_share(spark, table_words):
    """Without training, a document's score is its ids' log-probabilities, and for each word that shares an id its log share."""
    own = lm_score.VOCAB - lm_score.SHARED
    texts = [" ".join(f"t{i}" for i in range(own))] * 9 + ["t1 some rare words", "some t2 more rare rare", "", None, " ".join(f"w{i}" for i in range(5000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm_score.score_documents(df, rounds=0, table_words=table_words).collect()}
    w = Words(pa.array(texts))
    h = w.hashes()
    n = collections.Counter(h.tolist())
    top = sorted(n, key=lambda x: (-n[x], int(np.uint64(x).view(np.int64))))[:own]
    vocabulary = lm_score.Vocabulary(np.array(top, np.uint64))
    ids = vocabulary.ids(h)
    lp = lm_score.log_probs(lm_score.start_weights(), contexts(w, ids), ids)
    whole, kinds = collections.Counter(ids.tolist()), collections.Counter(vocabulary.ids(np.unique(h)).tolist())
    s = lm_score.SMOOTH
    share = [np.log((n[x] + s) / (whole[i] + s * (kinds[i] + 1))) if i < lm_score.SHARED else 0.0 for x, i in zip(h.tolist(), ids.tolist())]
    want = np.bincount(w.text_of(), lp + share, len(texts))
    assert set(got) == set(range(len(texts))) and sum(x < 0 for x in share) > 5000
    assert all(abs(got[i].log_prob - want[i]) < 1e-5 * max(1, abs(want[i])) for i in got)
