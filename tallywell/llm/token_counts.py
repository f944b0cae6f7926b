"""Token counts by a map-side two-tier lookup (see bpe.py)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .words import blocks


def frequent_pieces(texts: DataFrame, tokenizer: str, sample_docs: int, entries: int) -> list[str]:
    """The ``entries`` most frequent pre-tokens of about ``sample_docs`` texts, drawn by a hash of the text.

    Each task of the sample gives its ``entries`` most frequent ones; these are summed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = bpe.Encoder(tokenizer), Counter()
        for b in blocks(batches):
            seen.update(chain.from_iterable(encoder.cut(b.column("text").fill_null("").to_pylist())))
            if len(seen) > 8 * entries:
                seen = Counter(dict(seen.most_common(4 * entries)))
        top = seen.most_common(entries)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    every = max(1, texts.count() // sample_docs)
    sample = texts.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    counts = sample.mapInArrow(count, "piece string, n long").filter("char_length(piece) <= 64").groupBy("piece").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "piece").limit(entries).select("piece").toArrow().column(0).to_pylist()


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 512, cache_entries: int = 400_000, sample_docs: int = 10_000, table_entries: int = 100_000) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit.

    tokenizer: path of a byte-level BPE .json file, readable on every worker.
    The only broadcast is the first tier: the ``table_entries`` most frequent
    pre-tokens (of 64 characters at most) in about ``sample_docs`` texts. All
    other pre-tokens are encoded through the workers' caches, and texts that
    aren't plain (bpe.py) by the library as a whole. Counting is map-only: a lost
    executor costs its own tasks.

    Null text counts as empty: 0 bytes, 0 tokens. Null ids and repeated rows are
    counted like any other; other columns are not looked at; an empty table gives
    an empty result. Very long texts are encoded in parts, cut where white space
    ends a pre-token.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(bpe.frequent_lengths(tokenizer, frequent_pieces(rows.select("text"), tokenizer, sample_docs, table_entries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.Encoder(tokenizer, table.value, cache_entries)
        for b in blocks(batches):
            text = b.column("text").fill_null("")
            n = pa.array(encoder.lengths(text.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), pc.binary_length(text).cast(pa.int64()), n, pc.greater(n, max_tokens)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return rows.mapInArrow(run, schema)
