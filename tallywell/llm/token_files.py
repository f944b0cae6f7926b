"""Token-id files: raw id payloads in shards, each with a minimal perfect hash index, and one over all shards.

The file format is a folder of Parquet files, uncompressed, so that executors
write it through Spark to whatever store the path names.

shards/part=p: a row is a shard: seq (its place in the part), n_ids, dtype,
payload (ids of its documents one after another, little-endian, each document
closed by the end id), keys (the documents' ids, in payload order), seeds and
slots (the shard's index, slots of fingerprint u4, length u4, offset u8).

index/dir=d: a row is a bucket of keys: bucket, seeds and slots (fingerprint u4,
part u4, seq u4): the first shard that has the key.

meta: bits, the number of leading bits of a key's hash that name its bucket.

An index is a minimal perfect hash: a key hashes to one of about n/3 groups; the
group's seed sends its keys to places of their own among n slots (a group of one
key has the place itself, as a negative number). Finding a document is two such
lookups, of two hashes and two array reads each, in two rows of two files whose
folders are known beforehand, however many shards there are; a key that isn't
there is told by its fingerprint, but for one in 2**32.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .words import blocks, mix

SLOT = np.dtype([("fingerprint", "<u4"), ("length", "<u4"), ("offset", "<u8")])
PLACE = np.dtype([("fingerprint", "<u4"), ("part", "<u4"), ("seq", "<u4")])
BUCKET_KEYS = 8192  # about so many keys share a bucket of the index over all shards
DIR_BUCKETS = 256


def key_hashes(keys: list) -> np.ndarray:
    """64-bit hashes of (key, how many equal keys came before): repeated keys stay apart."""
    seen: dict = {}
    out = np.empty(len(keys), np.uint64)
    for i, k in enumerate(keys):
        n = seen[k] = seen.get(k, -1) + 1
        out[i] = int.from_bytes(hashlib.blake2b(f"{'' if k is None else k}\x00{n}\x00{k is None}".encode(), digest_size=8).digest(), "little")
    return out


def key_digest(key) -> tuple[int, int]:
    """Two 64-bit hashes of a key: the first names its bucket, the second its place there."""
    d = hashlib.blake2b(f"{'' if key is None else key}\x00{key is None}".encode(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")


def _place(h: np.ndarray, seed: np.ndarray | int, n: int) -> np.ndarray:
    return (mix(h + np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def build_index(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, place of each key): a minimal perfect hash of distinct 64-bit hashes."""
    n = len(h)
    bucket = (h % np.uint64(n // 3 + 1)).astype(np.int64)
    seeds, place, free = np.zeros(n // 3 + 1, np.int64), np.full(n, -1), np.ones(n, bool)
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0]) if n else np.zeros(0, np.int64)
    groups = sorted((order[a:b] for a, b in zip(starts, np.r_[starts[1:], n])), key=len, reverse=True)
    single = [g[0] for g in groups if len(g) == 1]
    for g in groups[: len(groups) - len(single)]:
        seed = 1
        while True:
            tried = _place(h[g], np.arange(seed, seed + 16).reshape(-1, 1), n)
            good = free[tried].all(1) & (np.diff(np.sort(tried, 1), axis=1) > 0).all(1)
            if good.any():
                k = int(good.argmax())
                seeds[bucket[g[0]]], place[g], free[tried[k]] = seed + k, tried[k], False
                break
            seed += 16
    for key, at in zip(single, np.flatnonzero(free)):
        seeds[bucket[key]], place[key] = -at - 1, at
    return seeds, place


def find(h: np.ndarray, seeds: bytes, slots: bytes, dtype: np.dtype = SLOT) -> tuple[np.ndarray, np.ndarray]:
    """(is there, slot) for each key hash."""
    seed, table = np.frombuffer(seeds, "<i8"), np.frombuffer(slots, dtype)
    if not len(table):
        return np.zeros(len(h), bool), np.zeros(len(h), dtype)
    s = seed[(h % np.uint64(len(seed))).astype(np.int64)]
    hit = table[np.where(s < 0, -s - 1, _place(h, np.maximum(s, 0), len(table)))]
    return hit["fingerprint"] == (h >> np.uint64(32)).astype(np.uint32), hit


def shard_schema(key: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("n_ids", T.LongType()), T.StructField("dtype", T.StringType()),
        T.StructField("payload", T.BinaryType()), T.StructField("keys", T.ArrayType(key)), T.StructField("seeds", T.BinaryType()), T.StructField("slots", T.BinaryType()),
    ])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 512 << 10) -> None:
    """Writes every document of ``docs``, in ascending order of id, to the folder ``path``.

    One shuffle: a range partitioning by (id, text hash), sorted within, so that
    part and seq give the order over the whole folder; equal ids are split over
    parts by their text if need be. Each task encodes as it reads and holds one
    shard of ``shard_bytes`` (a longer document is a shard of its own). A task
    that runs again writes the same shards. Then the index over all shards is made
    from their keys, which are dealt by bucket.

    Null text counts as empty: just the end id. Null ids come first. Repeated ids
    are documents of their own; by key the first of them is found. Other columns
    are not looked at. An empty table gives a folder with no shards. A very long
    text is encoded in parts.
    """
    key = docs.schema[id_col].dataType
    schema = shard_schema(key)
    arrow = pa.schema([pa.field(n, t) for n, t in (("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = bpe.Encoder(tokenizer), TaskContext.get().partitionId(), 0
        dtype = encoder.dtype
        end = np.array([end_id], dtype).tobytes()
        keys: list = []
        ids: list[bytes] = []
        kind, held = None, 0

        def shard() -> pa.RecordBatch:
            lengths = np.array([len(x) // dtype.itemsize for x in ids], np.int64)
            h = key_hashes(keys)
            seeds, place = build_index(h)
            slots = np.zeros(len(keys), SLOT)
            slots["fingerprint"][place], slots["length"][place], slots["offset"][place] = (h >> np.uint64(32)).astype(np.uint32), lengths, np.cumsum(lengths) - lengths
            row = [[part], [seq], [int(lengths.sum())], [dtype.name], pa.array([b"".join(ids)], pa.binary()), pa.array([keys], pa.list_(kind)), pa.array([seeds.astype("<i8").tobytes()], pa.binary()), pa.array([slots.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, arrow.field(i).type if i < 3 else pa.string()) for i, c in enumerate(row)], schema.names)

        for b in blocks(batches, limit=1 << 20):
            kind = b.schema.field("id").type
            for k, x in zip(b.column("id").to_pylist(), encoder.ids(b.column("text").to_pylist())):
                x = x.tobytes()
                if ids and held + len(x) > shard_bytes:
                    yield shard()
                    seq, keys, ids, held = seq + 1, [], [], 0
                keys.append(k)
                ids.append(x + end)
                held += len(x) + len(end)
        if ids:
            yield shard()

    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    raw = {"parquet.page.size.row.check.min": "4", "compression": "uncompressed", "parquet.enable.dictionary": "false"}
    rows.mapInArrow(run, schema).write.options(**raw).partitionBy("part").parquet(f"{path}/shards")
    _write_index(docs.sparkSession, path, schema, raw)


def read_shards(spark: SparkSession, path: str, key: T.DataType) -> DataFrame:
    return spark.read.schema(shard_schema(key)).parquet(f"{path}/shards")


def _write_index(spark: SparkSession, path: str, schema: T.StructType, raw: dict[str, str]) -> None:
    shards = spark.read.schema(schema).parquet(f"{path}/shards")
    n = shards.agg(F.sum(F.size("keys"))).first()[0] or 0
    bits = max(0, int(n // BUCKET_KEYS)).bit_length()
    spark.createDataFrame([(bits, schema["keys"].dataType.elementType.simpleString())], "bits int, key string").coalesce(1).write.parquet(f"{path}/meta")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, keys in zip(*[batch.column(c).to_pylist() for c in ("part", "seq", "keys")]):
                digests = [key_digest(k) for k in set(keys)]
                bucket, h = [d[0] >> (64 - bits) for d in digests], np.array([d[1] for d in digests], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(h.view(np.int64)), pa.array([part] * len(h), pa.int32()), pa.array([seq] * len(h), pa.int32())], ["bucket", "h", "part", "seq"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def row() -> pa.RecordBatch:
            h = np.array([x[0] for x in held], np.int64).view(np.uint64)
            seeds, place = build_index(h)
            slots = np.zeros(len(h), PLACE)
            slots["fingerprint"][place], slots["part"][place], slots["seq"][place] = (h >> np.uint64(32)).astype(np.uint32), [x[1] for x in held], [x[2] for x in held]
            return pa.RecordBatch.from_arrays([pa.array([at // DIR_BUCKETS], pa.int64()), pa.array([at], pa.int64()), pa.array([seeds.astype("<i8").tobytes()], pa.binary()), pa.array([slots.tobytes()], pa.binary())], ["dir", "bucket", "seeds", "slots"])

        for b in batches:
            for bucket, *x in zip(*[b.column(c).to_pylist() for c in ("bucket", "h", "part", "seq")]):
                if bucket != at and held:
                    yield row()
                    held = []
                at = bucket
                held.append(x)
        if held:
            yield row()

    first = shards.select("part", "seq", "keys").mapInArrow(hashed, "bucket long, h long, part int, seq int").groupBy("bucket", "h").agg(F.min(F.struct("part", "seq")).alias("s"))
    dealt = first.select("bucket", "h", "s.part", "s.seq").repartition(F.expr(f"bucket div {DIR_BUCKETS}")).sortWithinPartitions("bucket", "h")
    dealt.mapInArrow(build, "dir long, bucket long, seeds binary, slots binary").write.options(**raw).partitionBy("dir").parquet(f"{path}/index")


def _meta(spark: SparkSession, path: str):
    return spark.read.schema("bits int, key string").parquet(f"{path}/meta").first()


def describe_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row for each document, read from the files through their index: id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32 (of the ids as little-endian u4).

    Payloads are read where they lie; only digests of documents and sums of
    shards are shuffled. The running sum is over parts, then over the shards of a part.
    """
    key = T.DataType.fromDDL(_meta(spark, path).key)
    shards = read_shards(spark, path, key)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("id", key), T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                keys = row["keys"].values
                ids = np.frombuffer(row["payload"].as_py(), row["dtype"].as_py())
                there, slot = find(key_hashes(keys.to_pylist()), row["seeds"].as_py(), row["slots"].as_py())
                offset, length = slot["offset"].astype(np.int64), slot["length"].astype(np.int64)
                if not there.all():
                    raise ValueError(f"shard {row['part']}/{row['seq']}: a key of its own isn't in its index")
                crc = [zlib.crc32(ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(offset, length)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"].as_py()] * n, pa.int32()), pa.array([row["seq"].as_py()] * n, pa.int32()), keys, pa.array(offset), pa.array(length), pa.array(crc, pa.int64())], schema.names)

    found = shards.select("part", "seq", "dtype", "payload", "keys", "seeds", "slots").mapInArrow(read, schema)
    sums = shards.select("part", "seq", "n_ids")
    parts = sums.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("of_part"))
    within = sums.select("part", "seq", (F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("of_shard"))
    starts = within.join(parts, "part").select("part", "seq", (F.col("of_part") + F.col("of_shard")).alias("before"))
    return found.join(starts, ["part", "seq"]).select(F.col("id").alias(id_col), (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, path: str, key) -> list[int] | None:
    """The ids of one document (the first, if several have the key), or None: one row of the index, then one shard."""
    first, second = key_digest(key)
    bucket = first >> (64 - _meta(spark, path).bits)
    try:
        row = spark.read.schema("bucket long, seeds binary, slots binary").parquet(f"{path}/index/dir={bucket // DIR_BUCKETS}").filter(F.col("bucket") == bucket).first()
    except AnalysisException:
        return None
    there, slot = find(np.array([second], np.uint64), row.seeds, row.slots, PLACE) if row else ([False], None)
    if not there[0]:
        return None
    shard = spark.read.schema("seq int, dtype string, payload binary, seeds binary, slots binary").parquet(f"{path}/shards/part={slot['part'][0]}").filter(F.col("seq") == int(slot["seq"][0])).first()
    there, slot = find(key_hashes([key]), shard.seeds, shard.slots)
    return np.frombuffer(shard.payload, shard.dtype)[slot["offset"][0] :][: slot["length"][0]].tolist() if there[0] else None
