"""Substring dedup by seed and extend: winnowed anchors, extended both ways, maximal repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import bounded, save, settle
from .words import _INVERSE, _BASE, Words, _power, blocks, mix, runs


class Seeds:
    """Anchors and their extensions in some texts.

    Of the ``gram``-word runs in each window of ``length`` words the one with the
    least hash (the first of equals) is the window's anchor: equal windows have
    equal anchors in equal places, so anchors lose no repeat (winnowing).
    Neighbouring windows mostly share an anchor. Such a stretch, extended to all
    words of its windows, is a region.

    start: the first word of each window; window: its hash; region: the index of
    its region; anchor, extent: hashes of each region's anchor and of all its
    words with the anchor's place among them; doc: each region's text.
    """

    def __init__(self, w: Words, length: int, gram: int):
        h, doc = w.hashes(), w.text_of()
        n = len(h) - length + 1
        if n < 1:
            self.start = self.window = self.region = self.anchor = self.extent = self.doc = np.zeros(0, np.uint64)
            return
        self.start = start = np.flatnonzero(doc[:n] == doc[length - 1 :])
        grams = runs(h, gram)
        least = np.lib.stride_tricks.sliding_window_view(grams, length - gram + 1)
        at = start + (least.argmin(1)[start] if len(start) else 0)
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[start[1:]] != doc[start[:-1]])
        self.region = np.cumsum(new) - 1
        a = start[new]
        b = start[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]] + length if len(a) else a
        sums = np.r_[np.uint64(0), np.cumsum(h * _power(_BASE, len(h)), dtype=np.uint64)]
        place = at[new]
        self.anchor, self.doc = grams[place], doc[a]
        self.extent = mix(mix((sums[b] - sums[a]) * _power(_INVERSE, len(h) + 1)[a]) + ((b - a) * 64 + place - a).astype(np.uint64))
        self.window = runs(h, length)[start]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, gram: int = 5) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_removed, repeats, text.

    A word goes when it is in a window of ``length`` words whose words also
    start in a document with a smaller id, as judged on the input. ``repeats``
    are the maximal stretches removed, as (first word, word after the last);
    ``text`` is what stays, joined by single spaces.

    1. Seeds: every anchor of every document, summed by partial aggregation to
       the smallest and largest id; an anchor in one document only ends there.
    2. Extension: the other seeds, each with a hash of its whole region. A region
       that is the same in a document with a smaller id goes whole. Only the first
       of equal regions, and only where the same anchor has other regions, is
       looked into further: its windows are compared one by one.
    3. Windows: the smallest id for each; windows of larger ids go.
    4. What goes is gathered for each document (never more than its length) and
       joined with its text, where overlapping windows merge to maximal repeats.

    A passage in a third of all documents is a hot anchor, region and window: all
    three are summed by partial aggregation and written; the joins back are
    broadcasts while the sums are few (``BROADCAST_ROWS``), else equi-joins in
    stages of their own that the adaptive skew join splits. Nothing pairs documents.

    Null ids: such documents keep all words and take none from others. Rows of
    the same id are one document: they take nothing from each other, and each has
    marks of its own, told apart by a hash of the text. Null and
    empty texts have no words. An empty table gives an empty result; other columns
    are not looked at. Keys join two independent 64-bit hashes.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).withColumn("of", F.hash("text"))
    row, ids = ["id", "of"], [T.StructField("id", kind), T.StructField("of", T.IntegerType())]

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            s = Seeds(Words(b.column("text")), length, gram)
            doc = pa.array(s.doc.astype(np.int64))
            yield pa.RecordBatch.from_arrays([_signed(s.anchor), _signed(s.extent), b.column("id").take(doc), b.column("of").take(doc)], ["anchor", "extent", *row])

    long = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    seeded = rows.filter("id IS NOT NULL").mapInArrow(seeds, T.StructType([*long("anchor", "extent"), *ids]))
    common = save(seeded.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("anchor"), "substring-anchors")
    settle(spark)
    found = save(seeded.join(common, "anchor", "left_semi"), "substring-seeds")
    settle(spark)
    regions = save(found.groupBy("anchor", "extent").agg(F.min("id").alias("first")), "substring-firsts")
    several = save(regions.groupBy("anchor").agg((F.min("extent") != F.max("extent")).alias("several")), "substring-several")
    regions = save(regions.join(bounded(several), "anchor"), "substring-judged")
    judged = found.join(bounded(regions), ["anchor", "extent"]).select(*row, "extent", (F.col("id") > F.col("first")).alias("gone"), "several").filter("gone OR several")
    marks = judged.groupBy(*row).agg(F.collect_set(F.when(F.col("gone"), F.col("extent"))).alias("gone"), F.collect_set(F.when(~F.col("gone"), F.col("extent"))).alias("open"))
    marks = save(marks, "substring-regions")
    settle(spark)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            w = Words(b.column("text"))
            s = Seeds(w, length, gram)
            keep = _among(s.doc, s.extent, b.column("open"))[s.region] if len(s.start) else np.zeros(0, bool)
            region = s.region[keep].astype(np.int64)
            doc = pa.array(s.doc[region].astype(np.int64))
            yield pa.RecordBatch.from_arrays([_signed(s.anchor[region]), _signed(s.window[keep]), b.column("id").take(doc), b.column("of").take(doc)], ["anchor", "window", *row])

    opened = rows.join(marks.filter(F.size("open") > 0).select(*row, "open"), row)
    opened = save(opened.mapInArrow(windows, T.StructType([*long("anchor", "window"), *ids])), "substring-windows")
    settle(spark)
    firsts = save(opened.groupBy("anchor", "window").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last"), "substring-seen")
    later = opened.join(bounded(firsts), ["anchor", "window"]).filter("id > first").groupBy(*row).agg(F.collect_set("window").alias("windows"))
    marks = save(marks.select(*row, "gone").join(later, row, "full"), "substring-marks")
    settle(spark)

    repeats = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("after", T.IntegerType())]))
    out = T.StructType([T.StructField("id", kind), *long("n_words", "n_removed"), T.StructField("repeats", repeats), T.StructField("text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            w = Words(b.column("text"))
            gone = np.zeros(len(w.start), bool)
            if any(b.column(c).null_count < b.num_rows for c in ("gone", "windows")):
                s = Seeds(w, length, gram)
                if len(s.start):
                    away = _among(s.doc, s.extent, b.column("gone"))[s.region] | _among(s.doc[s.region], s.window, b.column("windows"))
                    edges = np.zeros(len(w.start) + 1, np.int64)
                    np.add.at(edges, s.start[away], 1)
                    np.add.at(edges, s.start[away] + length, -1)
                    gone = np.cumsum(edges[:-1]) > 0
            doc = w.text_of()
            removed = np.bincount(doc[gone], minlength=b.num_rows)
            first = np.flatnonzero(np.r_[True, (gone[1:] != gone[:-1]) | (doc[1:] != doc[:-1])][: len(doc)])
            spans: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for a, z in zip(first, np.r_[first[1:], len(doc)]):
                if gone[a]:
                    spans[doc[a]].append({"first": int(a - w.first[doc[a]]), "after": int(z - w.first[doc[a]])})
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(w.count.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))), joined(w, ~gone)], out.names)

    blank = rows.filter("id IS NULL").select("id", "text", F.lit(None).cast("array<long>").alias("gone"), F.lit(None).cast("array<long>").alias("windows"))
    marked = rows.filter("id IS NOT NULL").join(marks, row, "left").select("id", "text", "gone", "windows")
    return marked.union(blank).mapInArrow(cut, out).withColumnRenamed("id", id_col)


def _among(doc: np.ndarray, key: np.ndarray, lists: pa.Array) -> np.ndarray:
    """For each (text, key), whether the text's list has the key."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    if not len(flat):
        return np.zeros(len(key), bool)
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    salt = lambda k, d: mix(k + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.isin(salt(key, doc), salt(flat, owner))


def joined(w: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by single spaces."""
    doc = w.text_of()[keep]
    a, b = w.start[keep], w.end[keep]
    more = np.r_[doc[1:] == doc[:-1], False] if len(doc) else np.zeros(0, bool)  # a space follows
    size = b - a + more
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(a - (ends - size), size)
    data = w.data[at]
    data[ends[more] - 1] = 0x20
    offsets = np.r_[0, np.cumsum(np.bincount(doc, size, len(w.count)))].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(w.count), pa.py_buffer(offsets), pa.py_buffer(data.tobytes())).cast(pa.string())
