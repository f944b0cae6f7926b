"""Toxicity takes little of an executor: rows go to its Python workers in small batches, and all orders of the shared model are one plan."""

import pyarrow as pa

from tallywell.llm import session, toxicity


def test_texts_go_to_workers_in_small_batches(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 2_000) for i in range(1_000)], "doc_id long, text string").repartition(1)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "n"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    trained = toxicity.train(docs, labels)
    seen = docs.mapInArrow(sizes, "bytes long, n long").collect()
    assert sum(r.n for r in seen) == 1_000 and max(r.bytes for r in seen) < 1.5 * session.BATCH_BYTES
    assert toxicity.score_toxicity(docs, trained).count() == 1_000
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    session.small_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"


def test_shared_model_is_one_plan(spark, monkeypatch):
    saved, plain = [], toxicity.save
    monkeypatch.setattr(toxicity, "save", lambda df, name: saved.append(name) or plain(df, name))
    grams = toxicity.gram_counts(spark.createDataFrame([("abcabcé", 3, 1), ("bca", 0, 9), ("a", 2, 2)], "word string, toxic long, ordinary long"))
    shared = {r.gram: r.p for r in toxicity.shared_probabilities(grams).collect()}
    assert saved == ["toxic-shared"]
    assert set(shared) == {r.gram for r in grams.collect()} and all(0 < p < 1 for p in shared.values())
