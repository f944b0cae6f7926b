"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Each class, toxic and ordinary, has a model of how words are spelled: character
n-grams of up to six characters inside a word, its edges included. The highest
order is counted for each class alone, with an absolute discount; what the
discount frees goes to one interpolated Kneser-Ney model of both classes
together, whose lower orders are continuation counts. So a rare expression falls
back on the same shared counts in both classes, and the ratio of the two
likelihoods then says nothing but how often each class falls back there.

All counts, continuation counts and back-off weights are aggregations; the model
is a table of log-likelihood ratios by n-gram and by context. A document's score
compares its two likelihoods, normalised by its length: the mean log-ratio of an
n-gram, and the mean ratio of a word at two powers. A logistic function of these
and of the length, fitted on labelled rows that no count has seen, makes that a
score from 0 to 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import bounded, save, small_batches
from .words import Index, Words, blocks, mix

ORDER = 6
DISCOUNT = 4.0  # of each class: an n-gram that it has seen so often or less says nothing of its own
SHARED_DISCOUNT = 0.75
LONG = 24  # a longer word weighs as if it had so many n-grams
POWERS = (0.5, 1.0)
_RUN = re.compile(r"[^\W_]+")


def spell(word: str) -> list[str]:
    """The n-grams that spell a word: for each of its characters and its end, what came before and it."""
    s = f"^{word}$"
    return [s[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(s))]


# -- the model -----------------------------------------------------------------------------------------------------


def word_counts(rows: DataFrame) -> DataFrame:
    """rows(text, label) -> (word, toxic, ordinary): how often each word is in rows of either class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            w = Words(b.column("text"))
            if not len(w.start):
                continue
            toxic = b.column("label").to_numpy()[w.text_of()] == 1
            words, inverse = _distinct(w)
            n = [np.bincount(inverse, t, len(words)) for t in (toxic, ~toxic)]
            yield _summed((x, k) for word, *k in zip(words, *n) for x in _RUN.findall(word.lower()))

    return rows.mapInArrow(count, "key string, toxic long, ordinary long").groupBy(F.col("key").alias("word")).agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary): the sums over all words that an n-gram spells."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "word"):
            yield _summed((g, k) for word, *k in zip(*[c.to_pylist() for c in b.columns]) for g in spell(word))

    return words.select("word", "toxic", "ordinary").mapInArrow(count, "key string, toxic long, ordinary long").groupBy(F.col("key").alias("gram")).agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _summed(pairs: Iterator[tuple[str, list[float]]]) -> pa.RecordBatch:
    sums: dict[str, list[float]] = {}
    for key, k in pairs:
        s = sums.setdefault(key, [0, 0])
        s[0] += k[0]
        s[1] += k[1]
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *[pa.array([int(s[i]) for s in sums.values()], pa.int64()) for i in (0, 1)]], ["key", "toxic", "ordinary"])


def _context(gram: str) -> Column:
    return F.expr(f"substring({gram}, 1, char_length({gram}) - 1)")


def shared_probabilities(grams: DataFrame) -> DataFrame:
    """(gram, p): interpolated Kneser-Ney of both classes together, for each n-gram of ``grams``.

    Below the highest order a count is the number of different characters that
    come before; an n-gram that starts a word has no more context, and keeps its count.
    All orders are counted in one pass over the suffixes of the n-grams: a plan
    for each order would be compiled anew in every executor. What each order adds
    to its suffix is joined back and folded, shortest first; suffixes of one or two
    characters, which many n-grams end in, are broadcast while they are few.
    """
    suffixes = F.expr("transform(sequence(1, char_length(gram)), n -> right(gram, n))")
    own = grams.select("gram", F.lit(None).cast("long").alias("kinds"), (F.col("toxic") + F.col("ordinary")).alias("k"))
    known = grams.select(F.explode(suffixes).alias("gram")).distinct().filter(F.char_length("gram") > 1)
    before = known.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("kinds"))
    counts = before.select("gram", "kinds", F.lit(None).cast("long").alias("k")).union(own).groupBy("gram").agg(F.coalesce(F.max("k"), F.max("kinds")).alias("k"))
    x = W.partitionBy(_context("gram"))
    at = counts.select("gram", "k", F.sum("k").over(x).alias("total"), F.count(F.lit(1)).over(x).alias("kinds"))
    seen = F.greatest(F.col("k") - SHARED_DISCOUNT, F.lit(0.0)) / F.col("total")
    freed = SHARED_DISCOUNT * F.col("kinds") / F.col("total")
    at = save(at.select(F.col("gram").alias("suffix"), F.char_length("gram").alias("n"), seen.alias("seen"), freed.alias("freed")), "toxic-shared")
    letters = at.filter("n = 1").agg((1.0 / (F.count(F.lit(1)) + 1)).alias("lower"))
    ends = grams.select("gram", F.explode(suffixes).alias("suffix"))
    short, long = F.char_length("suffix") <= 2, F.char_length("suffix") > 2
    found = ends.filter(short).join(bounded(at.filter("n <= 2")), "suffix").union(ends.filter(long).join(at.filter("n > 2"), "suffix"))
    found = found.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("n", "seen", "freed"))).alias("orders")).crossJoin(F.broadcast(letters))  # letters: one row
    return found.select("gram", F.aggregate("orders", F.col("lower"), lambda p, o: o["seen"] + o["freed"] * p).alias("p"))


def ratios(grams: DataFrame) -> DataFrame:
    """(key, context, value): the log of toxic over ordinary probability of each n-gram, and of each context's back-off
    weights, which is what an n-gram not seen there is worth."""
    x = W.partitionBy("x")
    seen = grams.withColumn("x", _context("gram"))
    for c in ("toxic", "ordinary"):
        seen = seen.withColumn(f"all_{c}", F.sum(c).over(x)).withColumn(f"cut_{c}", F.sum(F.least(F.col(c).cast("double"), F.lit(DISCOUNT))).over(x))
    back = {c: F.when(F.col(f"all_{c}") > 0, F.col(f"cut_{c}") / F.col(f"all_{c}")).otherwise(1.0) for c in ("toxic", "ordinary")}
    over = {c: F.when(F.col(f"all_{c}") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"all_{c}")).otherwise(0.0) for c in ("toxic", "ordinary")}
    seen = seen.select("gram", "x", *[e.alias(f"{n}_{c}") for n, of in (("back", back), ("over", over)) for c, e in of.items()])
    p = {c: F.col(f"over_{c}") + F.col(f"back_{c}") * F.col("p") for c in ("toxic", "ordinary")}
    by_gram = seen.join(shared_probabilities(grams), "gram").select(F.col("gram").alias("key"), F.lit(False).alias("context"), F.log(p["toxic"] / p["ordinary"]).alias("value"))
    by_context = seen.groupBy(F.col("x").alias("key")).agg(F.lit(True).alias("context"), F.log(F.first("back_toxic") / F.first("back_ordinary")).alias("value"))
    return by_gram.union(by_context.select("key", "context", "value")).filter("value != 0")


def model_table(rows: DataFrame) -> DataFrame:
    """rows(text, label) -> (hash, value), written to the shared folder."""
    grams = save(gram_counts(word_counts(rows)), "toxic-grams")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = hash_strings(b.column("key").to_pylist(), b.column("context").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("value")], ["hash", "value"])

    return save(ratios(grams).mapInArrow(hashed, "hash long, value double"), "toxic-model")


class Model:
    """The table in memory: entries by hash."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        self.index = Index(hashes, spare=1)  # each worker of an executor holds one
        self.values = values[self.index.order].astype(np.float32)

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is there, value) for each hash."""
        at = self.index.find(h)
        there, value = at >= 0, np.zeros(len(h), np.float32)
        value[there] = self.values[at[there]]
        return there, value


_STEP = np.uint64(0x9FB21C651E98DF25)
_OF_CONTEXT = np.uint64(0x5851F42D4C957F2D)


def hash_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams that spell some words, of their contexts, and the index of each one's word."""
    lengths = np.array([len(w) + 2 for w in words])
    code = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    start = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    depth = np.arange(len(code)) - start[word]
    ctx, size = np.zeros(len(code), np.uint64), np.minimum(depth, ORDER - 1)
    for o in range(ORDER - 1, 0, -1):  # as the polynomial of the characters before, oldest first
        inside = depth >= o
        ctx[inside] = ctx[inside] * _STEP + code[np.flatnonzero(inside) - o] + np.uint64(1)
    keep = depth > 0
    full = ctx * _STEP + code + np.uint64(1)
    return mix(full + size.astype(np.uint64) + np.uint64(1))[keep], mix((ctx + size.astype(np.uint64)) ^ _OF_CONTEXT)[keep], word[keep]


def hash_strings(keys: list[str], context: np.ndarray) -> np.ndarray:
    """The hashes that hash_grams gives to n-grams and to contexts."""
    codes = np.array(keys, f"U{ORDER}")
    size = np.char.str_len(codes)
    m = codes.view("<u4").reshape(len(keys), ORDER).astype(np.uint64)
    h = np.zeros(len(keys), np.uint64)
    for i in range(ORDER):
        h = np.where(size > i, h * _STEP + m[:, i] + np.uint64(1), h)
    return np.where(context, mix((h + size.astype(np.uint64)) ^ _OF_CONTEXT), mix(h + size.astype(np.uint64)))


# -- evidence of texts ---------------------------------------------------------------------------------------------


def _distinct(w: Words) -> tuple[list[str], np.ndarray]:
    """The distinct words of some texts, and the index of each word's among them."""
    _, at, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
    return [w.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(w.start[at], w.end[at])], inverse


def _pieces(words: list[str]) -> tuple[list[str], np.ndarray]:
    """The runs of letters and digits in some strings, lower-cased, and the index of each one's string."""
    found = [_RUN.findall(w.lower()) for w in words]
    return [x for some in found for x in some], np.repeat(np.arange(len(words)), [len(x) for x in found])


def word_sums(ratio: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """For each word a row that is summed over a document: log-ratio, n-grams, one, and the ratio at each of POWERS.

    ratio, grams: the word's n-grams' summed log-ratios, and their number.
    """
    value = np.clip(ratio * np.minimum(1, LONG / np.maximum(grams, 1)), -300, 300)
    return np.stack([ratio, grams, np.ones(len(ratio)), *[np.exp(p * value) for p in POWERS]], 1)


def features(sums: np.ndarray) -> np.ndarray:
    """What the logistic function sees of a document: its length-normalised ratios, and its length. Zeros without words."""
    some = sums[:, 2] > 0
    s = np.where(some[:, None], sums, 1.0)
    out = [s[:, 0] / s[:, 1], np.log1p(s[:, 1]), *[np.log(s[:, 3 + i] / s[:, 2]) / p for i, p in enumerate(POWERS)]]
    return np.stack(out, 1) * some[:, None]


N_SUMS, N_FEATURES = 3 + len(POWERS), 2 + len(POWERS)


def text_sums(model: Model, texts: pa.Array) -> np.ndarray:
    """The summed rows of each text's words."""
    w = Words(texts)
    out = np.zeros((len(texts), N_SUMS))
    words, inverse = _distinct(w) if len(w.start) else ([], None)
    flat, owner = _pieces(words)
    if flat:
        grams, contexts, place = hash_grams(flat)
        there, value = model.look(grams)
        value = np.where(there, value, model.look(contexts)[1])
        rows = word_sums(np.bincount(place, value, len(flat)), np.bincount(place, minlength=len(flat)))
        doc = w.text_of()
        for i in range(N_SUMS):
            out[:, i] = np.bincount(doc, np.bincount(owner, rows[:, i], len(words))[inverse], len(texts))
    return out


class Scorer:
    """The logistic function over the features; without two classes to tell apart, a constant."""

    def __init__(self, prior: float = 0.0, mean: np.ndarray | None = None, sd: np.ndarray | None = None, beta: np.ndarray | None = None):
        self.prior, self.mean, self.sd, self.beta = min(max(prior, 0.0), 1.0), mean, sd, beta

    def scores(self, sums: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(sums), self.prior)
        x = (features(sums) - self.mean) / self.sd
        return 1 / (1 + np.exp(-np.clip(self.beta[0] + x @ self.beta[1:], -30, 30)))


_SUMS = [f"s{i}" for i in range(N_SUMS)]


class Trained:
    """A model's table and its scorer. The table is broadcast while it has at most ``max_entries`` rows, and joined by shuffle beyond."""

    def __init__(self, table: DataFrame | None, max_entries: int):
        self.table, self.scorer, self.held = table, Scorer(), None
        if table is not None and table.count() <= max_entries:
            t = table.toArrow()
            self.held = table.sparkSession.sparkContext.broadcast(Model(t.column("hash").to_numpy().astype(np.int64).view(np.uint64), t.column("value").to_numpy()))

    def sums(self, rows: DataFrame) -> DataFrame:
        """rows(text, ...) -> the other columns and the summed rows of each text; one row for each row."""
        kept = [f for f in rows.schema.fields if f.name != "text"]
        schema = T.StructType([*kept, *[T.StructField(c, T.DoubleType()) for c in _SUMS]])
        if self.table is None or self.held is not None:
            held = self.held

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in blocks(batches):
                    s = text_sums(held.value, b.column("text")) if held else np.zeros((b.num_rows, N_SUMS))
                    yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], *[pa.array(c) for c in s.T]], schema.names)

            return rows.mapInArrow(run, schema)
        return self._joined(rows, schema)

    def _joined(self, rows: DataFrame, schema: T.StructType) -> DataFrame:
        """The same by joins: words of each distinct text, n-grams of each distinct word, and sums back up."""
        key = F.struct(F.xxhash64("text"), F.xxhash64("text", F.lit(1)))
        texts = rows.select(F.coalesce("text", F.lit("")).alias("text")).select(key.alias("key"), "text")

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in blocks(batches):
                w = Words(b.column("text"))
                words, inverse = _distinct(w) if len(w.start) else ([], np.zeros(0, np.int64))
                flat, owner = _pieces(words)
                if flat:
                    pair, n = np.unique(w.text_of() * len(words) + inverse, return_counts=True)
                    by = np.argsort(owner, kind="stable")
                    first, many = np.searchsorted(owner[by], pair % len(words)), np.bincount(owner, minlength=len(words))[pair % len(words)]
                    at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                    yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(np.repeat(pair // len(words), many))), pa.array(flat, pa.string()).take(pa.array(by[at])), pa.array(np.repeat(n, many).astype(np.int64))], ["key", "word", "n"])

        def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in blocks(batches, "word", 1 << 16):
                gram, context, place = hash_grams(b.column("word").to_pylist())
                place = pa.array(place)
                yield pa.RecordBatch.from_arrays([b.column("a").take(place), b.column("b").take(place), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))], ["a", "b", "gram", "context"])

        uses = save(texts.dropDuplicates(["key"]).mapInArrow(split, T.StructType([T.StructField("key", texts.schema["key"].dataType), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])), "toxic-words")
        value = lambda name: self.table.select(F.col("hash").alias(name), F.col("value").alias(f"of_{name}"))
        hashed = [F.xxhash64("word").alias("a"), F.xxhash64("word", F.lit(1)).alias("b")]  # a long word stands once, not at each of its n-grams
        spelled = uses.select("word").distinct().select("word", *hashed).mapInArrow(grams, "a long, b long, gram long, context long").join(value("gram"), "gram", "left").join(value("context"), "context", "left")
        words = spelled.groupBy("a", "b").agg(F.sum(F.coalesce("of_gram", "of_context", F.lit(0.0))).alias("ratio"), F.count(F.lit(1)).cast("double").alias("grams"))
        v = F.greatest(F.lit(-300.0), F.least(F.lit(300.0), F.col("ratio") * F.least(F.lit(1.0), LONG / F.col("grams"))))
        each = [F.col("ratio"), F.col("grams"), F.lit(1.0), *[F.exp(p * v) for p in POWERS]]
        sums = uses.select("key", "n", *hashed).join(words.select("a", "b", *[e.alias(c) for c, e in zip(_SUMS, each)]), ["a", "b"]).groupBy("key").agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in _SUMS])
        own = rows.withColumn("key", F.struct(F.xxhash64(F.coalesce("text", F.lit(""))), F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)))).drop("text")
        return own.join(bounded(save(sums, "toxic-sums")), "key", "left").select(*[c for c in schema.names if c not in _SUMS], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in _SUMS])


# -- training and scoring ------------------------------------------------------------------------------------------


def fold(id_col) -> Column:
    return F.crc32(id_col.cast("string")) % 4


def fit(sums: DataFrame, prior: float = 0.0) -> Scorer:
    """sums(label, summed rows of a text) -> the logistic function fitted on all rows, by Newton steps with a small ridge.

    Features are written once; a step is one pass over them, in which each task
    sums its rows' gradient and curvature. The driver gets these sums alone: some
    twenty numbers for each task.
    """
    names = [f"x{i}" for i in range(N_FEATURES)]

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(np.stack([b.column(c).to_numpy() for c in _SUMS], 1))
            yield pa.RecordBatch.from_arrays([b.column("label"), *[pa.array(c) for c in x.T]], ["label", *names])

    rows = save(sums.select(F.col("label").cast("double").alias("label"), *_SUMS).mapInArrow(shape, T.StructType([T.StructField(c, T.DoubleType()) for c in ("label", *names)])), "toxic-fit")
    known = rows.agg(F.min("label").alias("least"), F.max("label").alias("most"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.avg, F.stddev_pop) for c in names]).first()
    if known.least == known.most:  # no rows, or one class
        return Scorer(prior)
    mean, sd = (np.array([known[f"{f}_{c}"] for c in names]) for f in ("avg", "stddev_pop"))
    sd, size = sd + 1e-9, N_FEATURES + 1
    beta, ridge = np.zeros(size), np.diag([1e-6] + [1.0] * N_FEATURES)
    for _ in range(50):

        def slopes(batches: Iterator[pa.RecordBatch], beta: np.ndarray = beta) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, size + 1))
            for b in batches:
                z = np.c_[np.ones(b.num_rows), (np.stack([b.column(c).to_numpy() for c in names], 1) - mean) / sd]
                p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
                total += np.c_[z.T @ (z * np.maximum(p * (1 - p), 1e-6)[:, None]), z.T @ (b.column("label").to_numpy() - p)]
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], ["total"])

        parts = rows.mapInArrow(slopes, "total array<double>").toArrow().column("total").to_pylist()
        total = np.sum(parts, 0).reshape(size, size + 1)
        step = np.linalg.solve(total[:, :size] + ridge, total[:, size] - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return Scorer(prior, mean, sd, beta)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_entries: int = 8_000_000) -> Trained:
    """Fits on all labelled rows whose fold is not 2: counts from folds 0 and 1, the logistic function from fold 3.

    Every word and n-gram of the former is counted, and every one of the latter
    is in the fit. Labels are broadcast to the texts while they are few, and both
    are dealt by id beyond. The driver gets a model of at most ``max_entries``
    rows (12 bytes each); a larger one stays a table. A document labelled twice
    has its higher label. Null ids, null labels, and labels of no document play
    no part; rows that repeat count again. With labels of one class only, every
    score is 0 or 1; with none, 0.
    """
    small_batches(docs.sparkSession)
    known = labels.filter(labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(F.max(labels[label_col]).cast("int").alias("label"))
    known = save(known.filter(fold(F.col("id")) != 2), "toxic-labels")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    pick = lambda cond: rows.join(bounded(known.filter(cond)), "id").select("text", "label")
    trained = Trained(model_table(pick(fold(F.col("id")) < 2)), max_entries)
    trained.scorer = fit(trained.sums(pick(fold(F.col("id")) == 3)), float(known.agg(F.avg("label")).first()[0] or 0.0))
    return trained


def _scored(rows: DataFrame, trained: Trained, threshold: float) -> DataFrame:
    """rows(text, ...) -> the other columns, score and predicted."""
    sums, scorer = trained.sums(rows), trained.scorer
    kept = [f for f in sums.schema.fields if f.name not in _SUMS]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scorer.scores(np.stack([b.column(c).to_numpy() for c in _SUMS], 1))
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema.names)

    return sums.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, trained: Trained, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row for each row of ``docs``: id, held_out (the fold that nothing was learned from), score, predicted.

    A map-only job while the model is broadcast; a larger model is joined, by the
    words of the distinct texts. The whole of every text is read, and nothing but
    the text. Null text counts as empty; an empty text has a score too, that of a
    text without evidence. Null ids are in no fold. Repeated rows score alike;
    other columns are not looked at; an empty table gives an empty result. A long
    text is split into words in windows: it needs a few times its own size.
    """
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(fold(docs[id_col]) == 2, F.lit(False)).alias("held_out"), docs[text_col].cast("string").alias("text"))
    return _scored(rows, trained, threshold).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, trained: Trained, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with their columns, that score below ``threshold``; repeats stay or go together.

    While the model is broadcast, rows are judged where they lie; else the
    texts that go are told by two hashes of them. Null and empty texts, and an
    empty table, are as in score_toxicity.
    """
    if trained.table is None or trained.held is not None:
        held, scorer, at = trained.held, trained.scorer, docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in blocks(batches, at):
                sums = text_sums(held.value, b.column(at)) if held else np.zeros((b.num_rows, N_SUMS))
                yield b.filter(pa.array(scorer.scores(sums) < threshold))

        return docs.mapInArrow(run, docs.schema)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    gone = _scored(docs.select(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"), text.alias("text")), trained, threshold).filter("predicted = 1")
    gone = bounded(save(gone.select(F.struct("a", "b").alias("h")).distinct(), "toxic-texts"))
    return docs.join(gone, F.struct(F.xxhash64(text), F.xxhash64(text, F.lit(1))) == gone["h"], "left_anti")
