"""Toxicity learns from every labelled row outside the held-out fold, however many there are."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywell.llm import toxicity


@pytest.mark.parametrize("few", [True, False])
def test_every_labelled_row_is_learned_from(spark, monkeypatch, few):
    """60,000 labelled texts, by broadcast and by shuffle: each of folds 0 and 1 is counted, and each of fold 3 is in the fit."""
    n, counted, fitted = 60_000, [], []
    if not few:
        monkeypatch.setattr(toxicity, "bounded", lambda df: df.hint("merge"))
    table, of = toxicity.model_table, toxicity.Trained.sums
    monkeypatch.setattr(toxicity, "model_table", lambda rows: counted.extend(r.text for r in rows.select("text").collect()) or table(rows))
    monkeypatch.setattr(toxicity.Trained, "sums", lambda self, rows: fitted.extend(r.text for r in rows.select("text").collect()) or of(self, rows))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string"), F.when(F.col("id") % 7 == 0, " zuxoq").otherwise("")).alias("text"))
    trained = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 7 == 0).cast("int").alias("toxic")))
    text = lambda i: f"w{i}" + (" zuxoq" if i % 7 == 0 else "")
    by = [zlib.crc32(str(i).encode()) % 4 for i in range(n)]
    assert sorted(counted) == sorted(text(i) for i in range(n) if by[i] < 2) and len(counted) > 24_000
    assert sorted(fitted) == sorted(text(i) for i in range(n) if by[i] == 3) and len(fitted) > 12_000
    assert trained.scorer.beta is not None


def test_fit_over_parts_is_the_fit_of_all_rows(spark):
    """The logistic function by sums over tasks, some of them empty, is the one fitted in memory."""
    r = np.random.default_rng(3)
    y = r.integers(0, 2, 400)
    sums = np.c_[r.normal(y[:, None], 2, (400, 1)) * 9, r.integers(5, 40, (400, 1)), r.integers(1, 5, (400, 1)), np.exp(r.normal(y[:, None], 1, (400, 2)))]
    sums[:9] = 0  # texts without words
    df = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(y, sums)], "label int, " + ", ".join(f"{c} double" for c in toxicity._SUMS))
    x = toxicity.features(sums)
    z = np.c_[np.ones(len(x)), (x - x.mean(0)) / (x.std(0) + 1e-9)]
    beta, ridge = np.zeros(5), np.diag([1e-6, 1, 1, 1, 1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta += np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ beta)
    for parts in (1, 7):
        got = toxicity.fit(df.repartition(parts, "label"))
        assert np.allclose(got.beta, beta, atol=1e-9) and np.allclose(got.mean, x.mean(0)) and np.allclose(got.sd, x.std(0) + 1e-9)
    one = toxicity.fit(df.filter("label = 1"), 1.0)
    assert one.beta is None and one.scores(sums[:3]).tolist() == [1.0] * 3
    assert toxicity.fit(df.limit(0)).scores(sums[:3]).tolist() == [0.0] * 3
