"""LM scoring by masked pseudo-likelihood under a bidirectional window network.

Each token is predicted from the ``R`` tokens on either side, itself left out:
their embeddings, side by side, feed a tanh layer, and a two-level softmax gives
the token's class and then the token within its class. Words without an id of
their own share ids, and such a word's probability is that of its id times its
smoothed share of the id's count. A document's score is the sum of the
log-probabilities of all its tokens.

The network is trained here, in numpy, on the documents: their ids are dealt to
shards of about SHARD tokens by a hash of the document, so that the outcome does
not depend on how the input is cut. In each round every shard starts from the
same weights, takes Adagrad steps over that round's positions of its own, and its
weights are averaged with all others', by the number of positions, in one
aggregation. The rounds deal out all positions of all documents: each is a target
in one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import fresh_path, save, settle
from .words import Index, Words, blocks, mix

R = 2  # tokens seen on each side
CLASSES, WITHIN = 32, 64
VOCAB = CLASSES * WITHIN
SHARED = 512  # a power of two: ids that the words without an id of their own share by hash
DIM, HIDDEN = 16, 32
_SHAPES = {"emb": (VOCAB + 1, DIM), "w": (2 * R * DIM, HIDDEN), "b": (HIDDEN,), "cw": (HIDDEN, CLASSES), "cb": (CLASSES,), "tw": (CLASSES, HIDDEN, WITHIN), "tb": (CLASSES, WITHIN)}
_STEP = 1 << 15
SMOOTH = 0.5  # added to the count of each word of a shared id, and once for words not seen
_CHUNK = 16 << 20  # bytes of text whose shared words are looked up together
_CHUNK_ROWS = 1 << 16
SHARD = 1 << 20  # tokens that are trained on one after another, about
_PIECE = 1 << 16  # tokens of a document that are dealt together
_SEEN = 0x8000  # marks an id that is context only
_SHIFTS = np.r_[-R:0, 1 : R + 1]


class Vocabulary:
    """Word hash -> id. The most frequent words have ids of their own, dealt over the classes; the others share."""

    def __init__(self, hashes: np.ndarray):
        self.index = Index(hashes)

    def ids(self, h: np.ndarray) -> np.ndarray:
        at = self.index.find(h)
        out = (mix(h) & np.uint64(SHARED - 1)).astype(np.int64)
        own = np.flatnonzero(at >= 0)
        out[own] = SHARED + self.index.order[at[own]]
        return out


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): the hash of every word of ``text``, and how often it occurs, written to the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            h, n = np.unique(np.concatenate([Words(b.column("text")).hashes() for b in chunk]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return save(texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")


def log_shares(counts: DataFrame, words: Broadcast) -> tuple[DataFrame, np.ndarray]:
    """(word, log_share) for each word of ``counts`` that shares an id; and by id the log of what its words share."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for b in batches:
            h, n = b.column("word").to_numpy().astype(np.int64).view(np.uint64), b.column("n").to_numpy()
            ids = words.value.ids(h)
            own = ids < SHARED
            yield ids[own], h[own], n[own]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, kinds = np.zeros(SHARED), np.zeros(SHARED)
        for ids, _, k in shared(batches):
            n += np.bincount(ids, k, SHARED)
            kinds += np.bincount(ids, minlength=SHARED)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHARED, dtype=np.int32)), pa.array(n), pa.array(kinds)], ["id", "n", "kinds"])

    sums = counts.mapInArrow(add, "id int, n double, kinds double").groupBy("id").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).toArrow()
    whole = np.ones(SHARED)
    whole[sums.column("id").to_numpy()] = sums.column("n").to_numpy() + SMOOTH * (sums.column("kinds").to_numpy() + 1)
    whole = np.log(whole)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, h, n in shared(batches):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.log(n + SMOOTH) - whole[ids])], ["word", "log_share"])

    return counts.mapInArrow(share, "word long, log_share double"), whole


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Blocks gathered to about _CHUNK bytes of text and at most _CHUNK_ROWS rows."""
    some, size, rows = [], 0, 0
    for b in blocks(batches):
        for a in range(0, b.num_rows, _CHUNK_ROWS):
            part = b.slice(a, _CHUNK_ROWS)
            n = pa.compute.sum(pa.compute.binary_length(part.column("text"))).as_py() or 0
            if some and (size + n > _CHUNK or rows + part.num_rows > _CHUNK_ROWS):
                yield some
                some, size, rows = [], 0, 0
            some.append(part)
            size, rows = size + n, rows + part.num_rows
    if some:
        yield some


def start_weights(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {k: (rng.normal(0, 0.1 if len(s) > 1 and not k.endswith("b") else 0, s)).astype(np.float32) for k, s in _SHAPES.items()}


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in _SHAPES])


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    ends = np.cumsum([int(np.prod(s)) for s in _SHAPES.values()])[:-1]
    return {k: x.reshape(s).astype(np.float32) for (k, s), x in zip(_SHAPES.items(), np.split(flat, ends))}


def stream(w: Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all documents, R times VOCAB before and after each, and the place of each token in them."""
    place = np.arange(len(ids)) + R * (w.text_of() + 1)
    out = np.full(len(ids) + R * (len(w.count) + 1), VOCAB, np.uint16)
    out[place] = ids
    return out, place


def pieces(w: Words, ids: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(document, number, ids) of parts of at most _PIECE tokens, with the context on both sides marked as such."""
    ids = ids.astype("<u2")
    for doc, (first, count) in enumerate(zip(w.first.tolist(), w.count.tolist())):
        for number, a in enumerate(range(first, first + count, _PIECE)):
            b, end = min(a + _PIECE, first + count), first + count
            before, after = ids[max(a - R, first) : a] | _SEEN, ids[b : min(b + R, end)] | _SEEN
            yield doc, number, np.concatenate([before, ids[a:b], after]).tobytes()


def steps(shard: int, ids: np.ndarray, rounds: int, turn: int, batch: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(contexts, targets) for each step over a shard's ids in one round; every position is in one of the rounds."""
    seen, known = ids & (_SEEN - 1), ids < _SEEN
    rng = np.random.default_rng([turn, shard & 0xFFFFFFFF, shard >> 32])
    for a in range(0, len(ids), _PIECE):
        at = np.arange(a, min(a + _PIECE, len(ids)))
        at = at[known[at] & (ids[at] != VOCAB)]
        drawn = mix(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(shard)) % np.uint64(rounds)
        at = rng.permutation(at[drawn == turn])
        for s in range(0, len(at), batch):
            some = at[s : s + batch]
            yield seen[some[:, None] + _SHIFTS].astype(np.int64), seen[some].astype(np.int64)


def _forward(p: dict, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = p["emb"].take(ctx, 0).reshape(len(ctx), -1)
    h = np.tanh(x @ p["w"] + p["b"])
    return x, h, _logits(h, p["cw"], p["cb"])


_ONES = {c: np.ones(max(CLASSES, WITHIN), c) for c in "fd"}


def _logits(h: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Clipped, so that their exponentials and the sums of these are within single precision."""
    z = h @ w
    z += b
    return _clipped(z)


def _clipped(z: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum(z, 60, out=z), -60, out=z)


def _total(x: np.ndarray) -> np.ndarray:
    """Sums of rows, as a product: a reduction over short rows is several times slower."""
    return x @ _ONES[x.dtype.char][: x.shape[1]]


def _by_class(target: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The classes of ascending ids, and where they are."""
    ends = np.searchsorted(target, np.arange(CLASSES + 1) * WITHIN)
    for c in range(CLASSES):
        if ends[c] < ends[c + 1]:
            yield c, slice(ends[c], ends[c + 1])


def shifted(p: dict[str, np.ndarray]) -> list[np.ndarray]:
    """What each id adds to the hidden layer at each place of the context."""
    return [p["emb"] @ p["w"][i * DIM : (i + 1) * DIM] for i in range(2 * R)]


def _log_probs(p: dict[str, np.ndarray], h: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The log-probabilities of some ids, in ascending order, given the hidden layer."""
    z = _logits(h, p["cw"], p["cb"])
    lp = z[np.arange(len(t)), t // WITHIN] - np.log(_total(np.exp(z)))
    for c, rows in _by_class(t):
        y = _logits(h[rows], p["tw"][c], p["tb"][c])
        lp[rows] += y[np.arange(len(y)), t[rows] % WITHIN] - np.log(_total(np.exp(y)))
    return lp


def log_probs(p: dict[str, np.ndarray], ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
    order = np.argsort(target, kind="stable")
    out = np.empty(len(target))
    out[order] = _log_probs(p, _forward(p, ctx[order])[1], target[order])
    return out


def stream_log_probs(p: dict[str, np.ndarray], parts: list[np.ndarray], ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The log-probability of the id at each place of a stream."""
    out = np.empty(len(place))
    for s in range(0, len(place), _STEP):
        at = place[s : s + _STEP]
        order = np.argsort(ids[at], kind="stable")
        at = at[order]
        h = p["b"] + parts[0][ids[at + _SHIFTS[0]]]
        for part, shift in zip(parts[1:], _SHIFTS[1:]):
            h += part[ids[at + shift]]
        out[s + order] = _log_probs(p, np.tanh(h, out=h), ids[at].astype(np.int64))
    return out


def train_step(p: dict, g2: dict, ctx: np.ndarray, t: np.ndarray, rate: float) -> None:
    """One Adagrad step on the mean negative log-likelihood of a batch."""
    n, order = len(t), np.argsort(t.astype(np.uint16), kind="stable")
    ctx, t = ctx.take(order, 0), t[order]
    x, h, z = _forward(p, ctx)
    d = np.exp(z)
    d /= _total(d)[:, None]
    d[np.arange(n), t // WITHIN] -= 1
    d /= n
    grad = {"cw": h.T @ d, "cb": d.sum(0), "tw": np.zeros_like(p["tw"]), "tb": np.zeros_like(p["tb"])}
    dh = d @ p["cw"].T
    # products by class; what goes element by element is done for all classes at once
    classes = list(_by_class(t))
    y = np.empty((n, WITHIN), h.dtype)
    for c, rows in classes:
        np.matmul(h[rows], p["tw"][c], out=y[rows])
    y += p["tb"].take(t // WITHIN, 0)
    np.exp(_clipped(y), out=y)
    y /= _total(y)[:, None]
    y[np.arange(n), t % WITHIN] -= 1
    y /= n
    for c, rows in classes:
        own = y[rows]
        dh[rows] += own @ p["tw"][c].T
        np.matmul(h[rows].T, own, out=grad["tw"][c])
        own.sum(0, out=grad["tb"][c])
    da = dh * (1 - h * h)
    grad["w"], grad["b"] = x.T @ da, da.sum(0)
    dx = (da @ p["w"].T).reshape(-1, DIM)
    flat = ctx.ravel().astype(np.uint16)
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.r_[True, flat[order][1:] > flat[order][:-1]])
    used = flat[order[first]]
    for k, g in grad.items():
        _adagrad(p[k], g2[k], g, rate)
    g = np.add.reduceat(dx.take(order, 0), first, 0)
    g2["emb"][used] += g * g
    p["emb"][used] -= rate * g / (np.sqrt(g2["emb"][used]) + 1e-8)


def _adagrad(p: np.ndarray, g2: np.ndarray, g: np.ndarray, rate: float) -> None:
    g2 += g * g
    step = np.sqrt(g2)
    step += 1e-8
    np.divide(g, step, out=step)
    step *= rate
    p -= step


def averaged(trained: DataFrame) -> dict[str, np.ndarray] | None:
    """trained(slice, n, value): sums of weights in slices, weighted by n -> their mean; None without any.

    Slices are summed as they stream by, so a task holds one sum for each of its own.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for i, n, v in zip(*[b.column(c).to_pylist() for c in ("slice", "n", "value")]):
                v = np.frombuffer(v, "<f8")
                have = sums.get(i)
                sums[i] = [n, v.copy()] if have is None else [have[0] + n, have[1] + v]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x[0] for x in sums.values()], pa.float64()), pa.array([x[1].tobytes() for x in sums.values()], pa.binary())], ["slice", "n", "value"])

    got = trained.repartition("slice").mapInArrow(add, _TRAINED).toArrow().sort_by("slice")  # _SLICES rows
    if not got.num_rows:
        return None
    return unpack(np.concatenate([np.frombuffer(v, "<f8") / n for n, v in zip(got.column("n").to_pylist(), got.column("value").to_pylist())]))


_TRAINED = "slice int, n double, value binary"
_SLICES = 64


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, batch: int = 2048, rate: float = 0.1, table_words: int = 200_000) -> DataFrame:
    """One row for each row of ``docs``: id, n_tokens, log_prob (summed), mean_log_prob (null without tokens).

    A token is a word ([^\\x20\\x09-\\x0D]+); the VOCAB - SHARED most frequent
    words of the corpus have ids of their own, all others share SHARED ids by
    hash, so the network's size is fixed. A word's share of such an id is
    (n + SMOOTH) / (N + SMOOTH * (D + 1)), of n occurrences of the word, N of all
    D words of the id. Training sees every position of every document once, dealt
    over ``rounds`` passes; scoring sees every token of every document.

    Gathered from the corpus: the counts of all words, and the ids of all
    documents by shard, which are written to the shared folder, and the weights of
    every task, summed in slices. All grow with the input, and what the driver
    receives of them, VOCAB + ``table_words`` words, SHARED sums and one set of
    weights, does not.
    Shares of the ``table_words`` most frequent words without an id of their own
    are broadcast; those of all others reach documents by a join on the word's
    hash: such words of a chunk of documents move once each, with the places of their documents in it, and come
    back with their shares. The scores without shares and these words are written
    to the shared folder, so a lost executor costs its tasks of a step.

    Shards, their order and the order of steps follow from ids and texts alone:
    another partitioning of the input gives the same scores but for rounding.
    Long texts are dealt, trained on and scored in pieces.

    Null and empty texts have no tokens: log_prob 0. Null ids, repeated rows and
    other columns change nothing. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    spark.sparkContext.environment.setdefault("OMP_NUM_THREADS", "1")  # a task has one core; more threads for its small products only wait
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    counts = word_counts(rows.select("text"))
    top = counts.orderBy(F.desc("n"), "word").limit(VOCAB - SHARED + table_words).toArrow().combine_chunks()
    frequent, times = top.column("word").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy()
    vocabulary = Vocabulary(frequent[: VOCAB - SHARED])
    words = spark.sparkContext.broadcast(vocabulary)
    shares, whole = log_shares(counts, words)
    frequent, times = frequent[VOCAB - SHARED :], times[VOCAB - SHARED :]
    common = Index(frequent)
    table = spark.sparkContext.broadcast((common, (np.log(times + SMOOTH) - whole[vocabulary.ids(frequent)])[common.order]))
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    shards = -(-tokens // SHARD)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            w = Words(b.column("text"))
            found = list(pieces(w, words.value.ids(w.hashes())))
            if found:
                doc, number, ids = zip(*found)
                key = b.column("key").to_numpy()[list(doc)]
                at = mix(key.view(np.uint64) + mix(np.array(number, np.uint64))) % np.uint64(shards)
                yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(key), pa.array(number, pa.int32()), pa.array(ids, pa.binary())], ["shard", "key", "number", "ids"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pieces of a shard in one row, or in several where it is large."""
        edge, at, held, size = np.full(R, VOCAB, "<u2").tobytes(), None, [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([edge + edge.join(held) + edge], pa.binary())], ["shard", "ids"])
        for b in batches:
            for shard, ids in zip(b.column("shard").to_pylist(), b.column("ids").to_pylist()):
                if held and (shard != at or size > 8 * SHARD):
                    yield row()
                    held, size = [], 0
                at = shard
                held.append(ids)
                size += len(ids)
        if held:
            yield row()

    weights = start_weights()
    if rounds and shards:
        key = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))).alias("key")
        dealt = rows.select(key, "text").mapInArrow(deal, "shard long, key long, number int, ids binary").repartition("shard").sortWithinPartitions("shard", "key", "number", "ids")
        path = fresh_path(spark, "lm-shards")
        dealt.select("shard", "ids").mapInArrow(gather, "shard long, ids binary").write.option("parquet.block.size", 4 * SHARD).option("parquet.page.size.row.check.min", 1).parquet(path)
        settle(spark)
    for turn in range(rounds if shards else 0):
        now = spark.sparkContext.broadcast(weights)

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros(sum(v.size for v in now.value.values())), 0
            for b in batches:
                for shard, ids in zip(b.column("shard").to_pylist(), b.column("ids").to_pylist()):
                    p = {k: v.copy() for k, v in now.value.items()}
                    g2 = {k: np.full_like(v, 1e-3) for k, v in p.items()}
                    n = 0
                    for ctx, t in steps(shard, np.frombuffer(ids, "<u2"), rounds, turn, batch):
                        train_step(p, g2, ctx, t, rate)
                        n += len(t)
                    total += pack(p).astype(np.float64) * n
                    seen += n
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SLICES, dtype=np.int32)), pa.array(np.full(_SLICES, float(seen))), pa.array([x.tobytes() for x in np.array_split(total, _SLICES)], pa.binary())], ["slice", "n", "value"])

        weights = averaged(spark.read.schema("shard long, ids binary").parquet(path).mapInArrow(fit, _TRAINED)) or weights
    final = spark.sparkContext.broadcast((weights, shifted(weights)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk its rows, without the shares of words, and then each of its shared words with the places of the rows it is in."""
        task = TaskContext.get().partitionId() << 32
        for number, chunk in enumerate(chunks(batches)):
            found, at, done = [], [], 0
            for b in chunk:
                w = Words(b.column("text"))
                h = w.hashes()
                ids = words.value.ids(h)
                lp = stream_log_probs(*final.value, *stream(w, ids))
                total = np.bincount(w.text_of(), lp, b.num_rows) if len(ids) else np.zeros(b.num_rows)
                own = np.flatnonzero(ids < SHARED)
                common, log_share = table.value
                near = common.find(h[own])
                known = near >= 0
                total += np.bincount(w.text_of()[own[known]], log_share[near[known]], b.num_rows)
                own = own[~known]
                found.append(h[own])
                at.append((w.text_of()[own] + done).astype(np.uint16))
                places = np.arange(done, done + b.num_rows, dtype=np.int32)
                done += b.num_rows
                none = [pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, task + number)), pa.array(places), b.column("id"), pa.array(w.count.astype(np.int64)), pa.array(total), *none], names)
            h, at = np.concatenate(found), np.concatenate(at)
            if not len(h):
                continue
            order = np.argsort(h)
            kinds = h[order]
            first = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
            kinds = kinds[first]
            ends = pa.array((np.r_[first, len(h)] * 2).astype(np.int32))
            places = pa.Array.from_buffers(pa.binary(), len(kinds), [None, ends.buffers()[1], pa.py_buffer(at[order].astype("<u2").tobytes())])
            for s in range(0, len(kinds), 1 << 16):
                k = len(kinds[s : s + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, task + number)), pa.nulls(k, pa.int32()), pa.nulls(k, chunk[0].column("id").type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.array(kinds[s : s + k].view(np.int64)), places.slice(s, k)], names)

    def total(base: pa.Table, shares: pa.Table) -> pa.Table:
        lp = base.column("log_prob").to_numpy().copy()
        if shares.num_rows:
            at = shares.column("places").to_pylist()
            n = np.fromiter(map(len, at), np.int64, len(at)) // 2
            extra = np.bincount(np.frombuffer(b"".join(at), "<u2"), np.repeat(shares.column("log_share").to_numpy(), n), _CHUNK_ROWS)
            lp += extra[base.column("row").to_numpy()]
        count = base.column("n_tokens").to_numpy()
        return pa.table([base.column("id"), base.column("n_tokens"), pa.array(lp), pa.array(lp / np.maximum(count, 1), mask=count == 0)], [id_col, "n_tokens", "log_prob", "mean_log_prob"])

    id_spark = docs.schema[id_col].dataType
    fields = {"chunk": T.LongType(), "row": T.IntegerType(), "id": id_spark, "n_tokens": T.LongType(), "log_prob": T.DoubleType(), "word": T.LongType(), "places": T.BinaryType()}
    names = list(fields)
    parts = save(rows.mapInArrow(score, T.StructType([T.StructField(k, t) for k, t in fields.items()])), "lm-parts")
    settle(spark)
    shares = parts.filter("word IS NOT NULL").select("chunk", "word", "places").join(shares, "word").select(F.col("chunk").alias("of"), "places", "log_share")
    base = parts.filter("word IS NULL").select("chunk", "row", "id", "n_tokens", "log_prob")
    schema = T.StructType([T.StructField(id_col, id_spark), T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType()), T.StructField("mean_log_prob", T.DoubleType())])
    return base.groupBy("chunk").cogroup(shares.groupBy("of")).applyInArrow(total, schema)
