"""Exact dedup by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import BROADCAST_ROWS, bounded, save


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged. All-ASCII text takes the fast path: there lower() does just that."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, digest_all: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the one with the largest id stays. Three rounds:

    1. rows by length in bytes: a length that occurs once ends there;
    2. the rest by (length, hash of the first ``prefix_chars`` characters);
    3. the rest by SHA-256 of the whole text, the only round that hashes whole
       texts. It does so beside the scan, so that digests travel and texts don't.

    ``sha256`` is null for rows that end before round 3, or has the digest of
    every row with ``digest_all``. Groups are counted with partial aggregation,
    so a group of copies of any size leaves one row for each task, and are
    written. The join back is a broadcast while groups are few
    (``BROADCAST_ROWS``); beyond, it is on the digest, whose hot values the
    adaptive skew join splits, as nothing else is done in that stage. Rows that
    have ended get a join key of their own instead of a shared null.

    Null ids: smaller than any other; a group of null ids only has keep_id null
    and all its rows stay. Rows that share the largest id are one document and
    all stay. Other columns are not looked at. An empty table gives an empty
    result.
    """
    base = docs.select(docs[id_col].alias("id"), lower_ascii(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("t"))
    size, prefix = F.octet_length("t").alias("size"), F.xxhash64(F.substring("t", 1, prefix_chars)).alias("prefix")
    probe = save(base.select(size, prefix), "dedup-probe")
    sizes = save(probe.groupBy("size").count().filter("count > 1").select("size"), "dedup-size")
    left = probe.join(bounded(sizes), "size", "left_semi")
    prefixes = save(left.groupBy("size", "prefix").count().filter("count > 1").select("size", "prefix", F.lit(True).alias("open")), "dedup-prefix")
    rows = base.select("id", size, prefix, *([F.sha2("t", 256).alias("sha256")] if digest_all else ["t"]))
    if digest_all or prefixes.count() <= BROADCAST_ROWS:
        rows = rows.join(bounded(prefixes), ["size", "prefix"], "left")
    else:  # the surviving groups don't fit: hash beside the scan what survives by length, and move digests
        rows = rows.join(bounded(sizes.withColumn("some", F.lit(True))), "size", "left").select("id", "size", "prefix", F.when(F.col("some"), F.sha2("t", 256)).alias("sha256")).join(prefixes, ["size", "prefix"], "left")
    digest = "sha256" if "sha256" in rows.columns else F.when(F.col("open"), F.sha2("t", 256)).alias("sha256")
    rows = save(rows.select("id", digest, F.coalesce("open", F.lit(False)).alias("open")), "dedup-rows")
    groups = save(rows.filter("open").groupBy(F.col("sha256").alias("key")).agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "dedup-groups")
    keyed = rows.withColumn("key", F.when(F.col("open"), F.col("sha256")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.coalesce(F.col("sha256"), F.lit("")))))
    return keyed.join(bounded(groups), "key", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | F.col("id").eqNullSafe(F.col("keep"))).alias("kept"),
        "sha256",
    )
