"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_dedup import lower_ascii
from .mixing import WORD
from .session import bounded, save

K = 5


def _words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def _places(words: Column) -> Column:
    """0 .. number of K-word shingles - 1; with fewer words 0, for all of them as one; without words nothing."""
    return F.when(F.size(words) >= K, F.sequence(F.lit(0), F.size(words) - K)).when(F.size(words) > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))


def _shingle_hashes(words: str) -> Column:
    """Hashes of the distinct shingles; ``words`` names a column of word hashes."""
    return F.array_distinct(F.transform(_places(F.col(words)), lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(K)])))


def _shingles(words: str) -> Column:
    return F.array_distinct(F.transform(_places(F.col(words)), lambda i: F.array_join(F.slice(F.col(words), i + 1, K), " ")))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(row, id, item, n_shingles, n_found, containment) for each document and test item
    where at least ``threshold`` of the item's distinct five-word shingles are in the document.

    Items are partitioned by size, in powers of two of their number n of
    shingles; a document visits those partitions only whose items are small enough
    for it to hold ``threshold`` of one. An item's MinHash sketch is the bottom-m of its shingle hashes. A
    document that holds the item misses at most e = n - ceil(threshold * n) of
    its shingles; partitions of small items take whole sets, those of larger ones
    m = 2 e + 1, of which such a document holds e + 1 at least. So the search
    needs no luck at any document length: it lets through every true pair, and
    pairs of a document with fewer hits go before any text is compared.
    Survivors are verified by the exact containment of the shingles' texts.

    Documents are read twice and their texts never move: sketches, and then the
    candidates, are broadcast while they are few (``BROADCAST_ROWS``), else
    joined by shuffle. ``row`` is a hash of id and text that tells apart rows of
    the same id. Words are as split by space and \\x09-\\x0D, A-Z lower-cased. Null
    text counts as empty. Fewer than five words are one shingle together: such an
    item is found in a document of just these words. Without words an item matches
    nothing. An empty table on either side gives an empty result. Repeated rows and items give one result each; null ids are
    kept as they are.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    row = F.xxhash64(F.coalesce(docs[id_col].cast("string"), F.lit("-")), text).alias("row")
    items = benchmark.select(benchmark[item_col].alias("item"), _words(benchmark[item_text_col]).alias("w"))
    items = items.select("item", _shingles("w").alias("shingles"), F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    items = items.select("item", "shingles", F.array_sort(_shingle_hashes("w")).alias("hashes")).filter(F.size("shingles") > 0)
    n = F.size("shingles")
    miss = n - F.ceil(F.lit(threshold) * n - 1e-9).cast("int")
    wide = F.floor(F.log2(n)).cast("int")  # the partition
    items = items.withColumn("partition", wide).withColumn("m", F.when(wide < 3, n).otherwise(F.least(n, 2 * miss + 1))).withColumn("least", F.col("m") - miss)
    items = save(items.dropDuplicates(["item", "shingles"]).withColumn("set", F.xxhash64(F.col("item").cast("string"), "shingles")), "leak-items")
    sketches = save(items.select("partition", "set", "least", F.explode(F.slice("hashes", F.lit(1), F.col("m"))).alias("h")), "leak-sketches")
    hashed = docs.select(row, F.octet_length(text).alias("size"), _words(text).alias("w")).select("row", "size", F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    # a document visits the partitions whose smallest item it could hold: it has at most a shingle for every two bytes
    largest = F.floor(F.log2((F.col("size") + 1) / F.lit(2.0 * threshold)) + 1e-9).cast("int").alias("largest")
    seen = hashed.select("row", largest, F.explode(_shingle_hashes("w")).alias("h"))
    hits = seen.join(bounded(sketches), "h").filter("partition <= largest").groupBy("row", "set", "least").agg(F.countDistinct("h").alias("hits"))
    candidates = save(hits.filter("hits >= least").select("row", "set"), "leak-candidates")
    texts = docs.select(row, docs[id_col].alias("id"), text.alias("text")).join(bounded(candidates), "row")
    pairs = texts.dropDuplicates(["row", "set"]).select("row", "id", "set", _words(F.col("text")).alias("w")).select("row", "id", "set", _shingles("w").alias("has"))
    pairs = pairs.join(bounded(items.select("set", "item", "shingles"), 20_000), "set")
    found = F.size(F.array_intersect("shingles", "has")).alias("n_found")
    pairs = pairs.select("row", F.col("id").alias(id_col), F.col("item").alias(item_col), F.size("shingles").alias("n_shingles"), found)
    return pairs.withColumn("containment", F.col("n_found") / F.col("n_shingles")).filter(F.col("n_found") >= F.lit(threshold) * F.col("n_shingles") - 1e-9)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that hold no test item; all rows if there are no items.

    Null and empty texts hold none; rows with null ids are judged as others, and
    repeated rows go or stay together.
    """
    bad = save(find_leaks(docs, benchmark, threshold, id_col, text_col).select("row").distinct(), "leak-rows")
    row = F.xxhash64(F.coalesce(docs[id_col].cast("string"), F.lit("-")), F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(bounded(bad), row == bad["row"], "left_anti")
