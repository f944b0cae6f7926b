"""N-gram Jaccard join by prefix trees of globally ordered n-gram sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .session import BROADCAST_ROWS, bounded, save, settle
from .words import Words, blocks, mix, runs

_TOP = np.uint64(1 << 63)
_CLASS = 1.34  # sizes of linked sets differ by a factor of 4 / 3 at most
_PASSES = 3  # over the texts: each deals the shingles of its remainder, and its shuffle goes before the next
_MARKS_AT_ONCE = 1.0  # sets whose bitmaps, and whose texts, move at once, by their shingles, as a share of those of all documents
_TEXTS_AT_ONCE = 0.25
_MOST_HELD = 20_000  # sets whose bitmaps one task holds against each other; a larger group is dealt to parts
_MOST_SCANS = 16  # scans of all texts so that what they are joined with can be broadcast


class Tree:
    """A prefix tree of sets, each in the global order, with the sizes below each node.

    An edge holds a run of n-grams, so that a stretch which sets share is stored
    and compared once. links(x) gives the stored sets y with
    100 * |x & y| >= 75 * |x | y|, that is 7 * overlap >= 3 * (|x| + |y|).
    """

    __slots__ = ("label", "below", "least", "most", "ends")

    def __init__(self, label: np.ndarray):
        self.label, self.below, self.least, self.most, self.ends = label, {}, 1 << 62, 0, []

    def add(self, x: np.ndarray, name: int) -> None:
        node, rest = self, x
        while True:
            node.least, node.most = min(node.least, len(x)), max(node.most, len(x))
            if not len(rest):
                node.ends.append(name)
                return
            child = node.below.get(int(rest[0]))
            if child is None:
                child = node.below[int(rest[0])] = Tree(rest)
                child.least, child.most = len(x), len(x)
                child.ends.append(name)
                return
            n = min(len(child.label), len(rest))
            same = child.label[:n] == rest[:n]
            n = n if same.all() else int(same.argmin())
            if n < len(child.label):  # part the edge
                fork = Tree(child.label[:n])
                fork.least, fork.most = child.least, child.most
                child.label = child.label[n:]
                fork.below[int(child.label[0])] = child
                node.below[int(rest[0])] = child = fork
            node, rest = child, rest[n:]

    def links(self, x: np.ndarray, known) -> Iterator[int]:
        """known(name): whether the link is of no interest; asked before the work, again and again."""
        size, step = len(x), 64
        todo = [(self, 0, 0)]
        while todo:
            node, overlap, depth = todo.pop()
            for child in node.below.values():
                if 4 * child.most < 3 * size or 4 * size < 3 * child.least:
                    continue
                if not child.below and all(known(y) for y in child.ends):
                    continue
                over, label, cut = overlap, child.label, False
                for a in range(0, len(label), step):
                    part = label[a : a + step]
                    at = np.searchsorted(x, part)
                    over += int((x[np.minimum(at, size - 1)] == part).sum())
                    # what can still come: n-grams of x after the last one compared, or of the largest set below
                    left = min(size - int(np.searchsorted(x, part[-1], "right")), child.most - depth - a - len(part))
                    if 7 * (over + left) < 3 * (size + child.least):
                        cut = True
                        break
                if cut:
                    continue
                for y in child.ends:
                    if 7 * over >= 3 * (size + depth + len(label)):
                        yield y
                if child.below:
                    todo.append((child, over, depth + len(label)))


class Sets:
    """The n-gram sets of some texts: names (0 for the empty set), and sorted arrays of 64-bit values in the global order.

    The global order: n-grams that are not among ``frequent`` first, by hash,
    then the frequent ones, the most frequent last.
    """

    def __init__(self, texts: pa.Array, k: int, frequent: np.ndarray | None = None, rank: np.ndarray | None = None):
        w = Words(texts, lower=True)
        h = w.hashes()
        grams = runs(h, k) >> np.uint64(1)
        self.values = []
        for first, count in zip(w.first, w.count):
            if count >= k:
                v = grams[first : first + count - k + 1]
            else:
                v = mix(runs(h[first : first + count], int(count)) + np.uint64(count)) >> np.uint64(1) if count else h[:0]
            self.values.append(np.unique(v))
        self.sizes = np.array([len(v) for v in self.values], np.int64)
        flat = np.concatenate(self.values) if self.values else h[:0]
        ends = np.cumsum(self.sizes)
        sums = np.r_[np.uint64(0), np.cumsum(mix(flat), dtype=np.uint64)]
        name = mix(sums[ends] - sums[ends - self.sizes] + self.sizes.astype(np.uint64)) >> np.uint64(1) | np.uint64(1)
        self.names = np.where(self.sizes > 0, name, 0).astype(np.int64)
        if frequent is not None and len(frequent):
            at = np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)
            hot = frequent[at] == flat
            if hot.any():
                flat = np.where(hot, _TOP | rank[at], flat)
                self.values = [np.sort(v) for v in np.split(flat, ends[:-1])]


def signature(v: np.ndarray) -> bytes:
    """A bitmap of a set's hashes, of at least two bits for each and a power of two."""
    bits = np.zeros(1 << max(6, int(2 * len(v) - 1).bit_length()), np.uint8)
    bits[(v & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


#: Floats of bits that are held at once.
_HELD_BITS = 1 << 20


def _folded(sizes: np.ndarray, signatures: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sets in ascending size: their order, sizes, bitmaps folded to ``width`` bytes, and n-grams that share their bit with another one."""
    order = np.argsort(sizes, kind="stable")
    rows = np.empty((len(order), width // 8), np.uint64)
    for i, k in enumerate(order):
        rows[i] = np.bitwise_or.reduce(np.frombuffer(signatures[k], np.uint64).reshape(-1, width // 8), 0)
    return order, sizes[order], rows, (sizes[order] - np.bitwise_count(rows).sum(1, dtype=np.int64)).astype(np.float32)


def _bits(rows: np.ndarray) -> np.ndarray:
    return np.unpackbits(rows.view(np.uint8), axis=1).astype(np.float32)


def may_link(sizes: np.ndarray, signatures: list[bytes]) -> np.ndarray:
    """Whether each set may link with another one of them, by what their bitmaps allow.

    A bit that only x has stands for an n-gram that y lacks, so the overlap is at
    most |x| less the number of such bits, and the same the other way round. Bits in
    common are a matrix product, block by block of sets of like size. Two sets that are known to have a
    partner are not held against each other, so sets that all resemble each other cost one block of comparisons each.
    """
    order, n, rows, spare = _folded(sizes, signatures, width := min(map(len, signatures)))
    size = n.astype(np.float32)
    out = np.zeros(len(n), bool)
    ends = np.searchsorted(n, n * 4 // 3, "right")
    many = max(1, min(2048, _HELD_BITS // (8 * width)))
    few = min(128, many)
    for a in range(0, len(n), few):
        i = np.arange(a, min(a + few, len(n)))
        x = _bits(rows[i])
        for c in range(a, int(ends[i[-1]]), many):
            j = np.arange(c, min(c + many, int(ends[i[-1]])))
            alone_i, alone_j = ~out[i], ~out[j]
            if not alone_i.any() and not alone_j.any():
                continue
            left = np.arange(len(i)) if alone_j.any() else np.flatnonzero(alone_i)
            j = j if alone_i.any() else j[alone_j]
            common = (x if len(left) == len(i) else x[left]) @ _bits(rows[j]).T
            u = i[left]
            common += np.minimum(spare[u][:, None], spare[j])
            hit = common >= (3 / 7 - 1e-6) * (size[u][:, None] + size[j])
            hit[u[:, None] == j] = False
            out[u] |= hit.any(1)
            out[j] |= hit.any(0)
    back = np.zeros(len(n), bool)
    back[order] = out
    return back


def may_meet(sizes: np.ndarray, signatures: list[bytes], of_hosts: np.ndarray, hosts: list[bytes]) -> np.ndarray:
    """Whether each set may link with one of the hosts, by the same bound."""
    out = np.zeros(len(sizes), bool)
    if not len(sizes) or not hosts:
        return out
    width = min(map(len, [*signatures, *hosts]))
    order, n, rows, spare = _folded(sizes, signatures, width)
    _, m, others, room = _folded(of_hosts, hosts, width)
    many = max(1, min(2048, _HELD_BITS // (8 * width)))
    few = min(128, many)
    for a in range(0, len(n), few):
        u = np.arange(a, min(a + few, len(n)))
        x, found = _bits(rows[u]), np.zeros(len(u), bool)
        last = int(np.searchsorted(3 * m, 4 * n[u[-1]], "right"))
        for c in range(int(np.searchsorted(4 * m, 3 * n[u[0]])), last, many):
            j, left = np.arange(c, min(c + many, last)), np.flatnonzero(~found)
            if not len(left):
                break
            common = x[left] @ _bits(others[j]).T + np.minimum(spare[u[left]][:, None], room[j])
            found[left] = (common >= (3 / 7 - 1e-6) * (n[u[left]][:, None] + m[j])).any(1)
        out[order[u]] = found
    return out


_SALTED, _SALTS = np.uint64(1 << 62), np.uint64(((1 << 30) - 1) << 32)  # marks of a frequent n-gram that is dealt to several tasks


class Meeting:
    """Rows (gram, name, n) in the order of (gram, name), batch by batch -> who meets there.

    For an n-gram in two to ``most`` sets the pairs of these, with the first as
    pivot; for one in more sets, or salted, its rows as postings. No more than a
    batch is held: of a long run the rows go out as they come.
    """

    def __init__(self, most: int):
        self.most, self.held, self.open = max(most, 1), [np.zeros(0, np.int64) for _ in range(3)], None

    def add(self, *batch: np.ndarray, last: bool = False) -> Iterator[pa.RecordBatch]:
        g, name, n = (np.concatenate([a, b]) for a, b in zip(self.held, batch))
        if not len(g):
            return
        new = np.r_[True, (g[1:] != g[:-1]) | (name[1:] != name[:-1])]
        g, name, n = g[new], name[new], n[new]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        stop = len(g) if last else int(first[-1])  # the last run may go on
        long = not last and (len(g) - stop > self.most or g[-1] == self.open)
        if long:
            stop = len(g)
        first = first[first < stop]
        size, u = np.diff(np.r_[first, stop]), g.view(np.uint64)
        many = (size > self.most) | (u[first] >= _TOP) & (u[first] & _SALTED > 0)
        if self.open is not None:
            many |= g[first] == self.open
        self.held, self.open = [x[stop:] for x in (g, name, n)], int(g[-1]) if long else None
        rows = np.repeat(many, size)
        if rows.any():
            at = u[:stop][rows]
            plain = np.where((at >= _TOP) & (at & _SALTED > 0), at & ~(_SALTED | _SALTS), at)
            yield self._batch(plain.view(np.int64), None, name[:stop][rows], None, None, n[:stop][rows])
        for k in range(2, self.most + 1):
            at = first[(size == k) & ~many]
            if len(at):
                i, j = np.triu_indices(k, 1)
                i, j = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                fit = 4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])
                pivot = name[np.repeat(at, k * (k - 1) // 2)]
                yield self._batch(None, pivot[fit], name[i[fit]], name[j[fit]], n[i[fit]], n[j[fit]])

    @staticmethod
    def _batch(*columns: np.ndarray | None) -> pa.RecordBatch:
        size = len(columns[2])
        return pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()) if c is None else pa.array(c) for c in columns], ["gram", "pivot", "x", "y", "m", "n"])


def _prefix(v: np.ndarray) -> np.ndarray:
    """A set that links with v shares an n-gram of this prefix, which is in its own prefix too."""
    return v[: len(v) - (3 * len(v) + 3) // 4 + 1] if len(v) else v


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, max_frequent: int = 100_000, max_listed: int = 16, block_grams: int = 400_000, salt_rows: int = 50_000) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id.

    A document's set is its distinct ``k``-word shingles, A-Z lower-cased; with
    fewer words, all of them as one; without words, empty and linked with
    nothing. Two documents link when 100 * |intersection| >= 75 * |union|.
    component_id is the least id reachable by links, its own included.

    1. One pass names every set by a hash and counts shingles that repeat within
       a batch. The ``max_frequent`` most frequent ones (a broadcast of fixed size)
       go last in the global order; it decides how much work there is, and
       never what links. Equal sets are one from here on.
    2. Prefixes: linked sets share a shingle within the first quarter of each in
       the global order. These prefixes are dealt by shingle, once, a third of all
       shingles in each of three passes over the texts; a task passes
       a set on once, however many copies it has, and a frequent shingle with more
       than ``salt_rows`` rows is dealt to several tasks. Sorted by shingle they
       stream by: nothing is gathered.
    3. Blocks. The pairs of sets of a shingle with at most ``max_listed`` sets are
       counted: with m and n shingles, and so a = ceil(3 (m + n) / 7) common ones
       if they link, two sets share at least a + 1 - ceil(3 max(m, n) / 4) in
       their prefixes. Pairs short of that go; others get the least pivot (first
       set) of their shingles as block. A shingle in more sets is split by size
       class first: a set is in its own and the next, so that two sets that may
       link, whose sizes differ by a third at most, meet in the class of the
       larger. Where a class still has more sets, these meet at its pivot. Sets
       of a pivot and class, those of pairs too, are held against each other as
       bitmaps first, two to four bits for a shingle, whose bound on the overlap
       lets few pass that don't link. More sets than fit in one task are dealt to
       parts, and those that find nothing in their own part visit the others. Only
       the texts of sets that passed move.
    4. In a block, a prefix tree is searched and grown by sets in ascending size.
       Sets already in one component are not compared again, so a block of
       n near copies costs about n verifications, and yields at most n - 1 links.
    5. A block beyond ``block_grams`` shingles is split into parts. Each part is
       searched by itself; then one set of each component of each part meets the
       others' ones; then the sets that are not in the block's main component yet
       visit all its parts. So a large group of near copies moves once, and no
       pair is lost: of two sets in different components one is a visitor.
    6. Connected components of the links, then the least id of each.

    Bitmaps and texts move in as many turns as keep each turn's shuffle a fixed
    share of the input, however many blocks a set is in, and the shuffle files of
    a turn go before the next: what lies on disk at once grows with the input.

    Null ids are larger than any other; a component of null ids only has a null
    component_id. Repeated rows are equal sets. Null texts count as empty. An
    empty table gives an empty result; other columns are not looked at. A long
    text needs some tens of bytes for each of its words. Shingles and sets are
    known by hashes of 63 bits.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    key = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))).alias("key")
    rows = rows.select(key, "id", "text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            s = Sets(b.column("text"), k)
            values, times = np.unique(np.concatenate(s.values), return_counts=True)
            often = times >= 4
            lists = [pa.array([x[often].astype(np.int64)] + [[]] * (b.num_rows - 1), pa.list_(pa.int64())) for x in (values, times)]
            marks = pa.array([signature(v) for v in s.values], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), pa.array(s.sizes), pa.array(s.names), marks, *lists], named_schema.names)

    many = T.ArrayType(T.LongType())
    named_schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", kind), *[T.StructField(c, t) for c, t in (("n", T.LongType()), ("name", T.LongType()), ("marks", T.BinaryType()), ("often", many), ("times", many))]])
    named = save(rows.mapInArrow(describe, named_schema), "join-sets")
    often = named.filter(F.size("often") > 0).select(F.explode(F.arrays_zip("often", "times")).alias("x")).groupBy(F.col("x.often").alias("h")).agg(F.sum("x.times").alias("n")).orderBy(F.desc("n"), "h").limit(max_frequent).toArrow()
    hashes = often.column("h").to_numpy().astype(np.uint64)
    order = np.argsort(hashes)
    ranks = (len(hashes) - order).astype(np.uint64)
    salts = np.r_[1, -(-often.column("n").to_numpy()[::-1] // salt_rows)].astype(np.uint64)  # by rank, which counts from the least frequent
    frequent = spark.sparkContext.broadcast((hashes[order], ranks, salts))
    marks, named = named.select("name", "marks"), named.select("key", "id", "n", "name")

    def prefixes(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in blocks(batches):
            s = Sets(b.column("text"), k, *frequent.value[:2])
            heads, sizes = [], []
            for i, name in enumerate(s.names.tolist()):
                new = name not in seen
                if new:
                    seen.add(name)
                heads.append(_prefix(s.values[i]) if new else s.values[i][:0])
                sizes.append(len(heads[-1]))
            if len(seen) > 1 << 20:
                seen = set()
            gram, name, n = np.concatenate(heads), np.repeat(s.names, sizes), np.repeat(s.sizes, sizes)
            own = gram % np.uint64(_PASSES) == turn
            gram, name, n = gram[own], name[own], n[own]
            hot = np.flatnonzero(gram >= _TOP)
            salt = frequent.value[2][(gram[hot] ^ _TOP).astype(np.int64)]
            hot, salt = hot[salt > 1], salt[salt > 1]
            gram[hot] |= _SALTED | (name.view(np.uint64)[hot] % salt) << np.uint64(32)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(name), pa.array(n)], ["gram", "name", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Meeting(max_listed)
        for b in batches:
            yield from m.add(*[b.column(c).to_numpy() for c in ("gram", "name", "n")])
        yield from m.add(*[np.zeros(0, np.int64)] * 3, last=True)

    def met_in(turn: int) -> DataFrame:
        grams = rows.mapInArrow(lambda batches: prefixes(batches, turn), "gram long, name long, n long").repartition("gram").sortWithinPartitions("gram", "name")
        return settled(save(grams.mapInArrow(meet, "gram long, pivot long, x long, y long, m long, n long"), "join-met"))

    def settled(df: DataFrame) -> DataFrame:
        settle(spark)
        return df

    met = reduce(DataFrame.union, [met_in(turn) for turn in range(_PASSES)])
    every = named.agg(F.sum("n")).first()[0] or 1
    turns = lambda moved, share: max(1, math.ceil((moved.agg(F.sum("n")).first()[0] or 0) / (share * every)))
    pairs = met.filter("gram IS NULL").select("pivot", "x", "y", "m", "n")
    both = """flatten(transform(sequence(0, size(s) - 2), i -> transform(slice(s, i + 2, size(s)), y -> struct(s[i] AS x, y AS y))))"""
    fit = "4 * least(p.x.n, p.y.n) >= 3 * greatest(p.x.n, p.y.n)"
    pair = [F.col("p.x.name").alias("x"), F.col("p.y.name").alias("y"), F.col("p.x.n").alias("m"), F.col("p.y.n").alias("n")]
    size_class = F.floor(F.log("n") / math.log(_CLASS)).cast("int")
    posted = met.filter("gram IS NOT NULL").select("gram", F.col("x").alias("name"), "n").distinct()
    posted = posted.withColumn("own", size_class).withColumn("class", F.explode(F.array("own", F.col("own") + 1))).withColumn("own", F.col("own") == F.col("class"))
    posted = save(posted, "join-postings")
    groups = posted.groupBy("gram", "class").agg(F.count(F.lit(1)).alias("sets"), F.max("own").alias("any"), F.min("name").alias("pivot")).filter("sets > 1 AND any")
    posted = posted.join(bounded(save(groups.drop("any"), "join-groups")), ["gram", "class"])
    more = posted.filter(F.col("sets") <= max_listed).groupBy("gram", "class", "pivot").agg(F.sort_array(F.collect_list(F.struct("name", "n", "own"))).alias("s"))
    more = more.select("pivot", F.expr(f"explode(filter({both}, p -> (p.x.own OR p.y.own) AND {fit}))").alias("p")).select("pivot", *pair)
    pairs = pairs.union(more).groupBy("x", "y", "m", "n").agg(F.count(F.lit(1)).alias("shared"), F.min("pivot").alias("pivot"))
    pairs = pairs.filter("shared >= (3 * (m + n) + 6) div 7 + 1 - (3 * greatest(m, n) + 3) div 4")
    paired = pairs.withColumn("both", F.expr("array(struct(x AS name, m AS n), struct(y AS name, n AS n))")).withColumn("n", F.greatest("m", "n")).select("pivot", size_class.alias("class"), F.explode("both").alias("s")).select("pivot", "class", "s.*")
    wide = save(posted.filter(F.col("sets") > max_listed).select("pivot", "class", "name", "n").union(paired).distinct(), "join-wide")
    held = F.greatest(F.ceil(F.sum("n") / (10 * block_grams)), F.ceil(F.count(F.lit(1)) / _MOST_HELD)).cast("int")
    asked = wide.join(bounded(save(wide.groupBy("pivot", "class").agg(held.alias("parts")), "join-wide-sums")), ["pivot", "class"])
    asked = asked.select("pivot", "class", F.pmod(F.xxhash64("name"), "parts").cast("int").alias("part"), "parts", "name", "n", F.lit(False).alias("guest"))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, held in _blocks(batches, keys, ("name", "n", "marks")):
            may = may_link(np.array([x[1] for x in held]), [x[2] for x in held])
            yield noted(place, held, may, may | (place[3] > 1))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hosts = None, []
        for place, held in _blocks(batches, (*keys, "guest"), ("name", "n", "marks"), 4096):
            if place[:3] != at:
                at, hosts = place[:3], []
            if place[4]:
                may = may_meet(np.array([x[1] for x in held]), [x[2] for x in held], np.array([x[1] for x in hosts]), [x[2] for x in hosts])
                yield noted(place, held, may, may)
            else:
                hosts += held

    keys = ("pivot", "class", "part", "parts")
    noted_schema = "pivot long, class int, part int, parts int, name long, n long, may boolean"

    def noted(place: tuple, held: list[tuple], may: np.ndarray, kept: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(kept)
        same = [pa.array(np.full(len(at), x), t) for x, t in zip(place, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*same, *[pa.array([held[i][k] for i in at], pa.int64()) for k in (0, 1)], pa.array(may[at])], [*keys, "name", "n", "may"])

    def narrowed(dealt: DataFrame, by, name: str) -> DataFrame:
        times = turns(dealt, _MARKS_AT_ONCE)

        def of(turn: int) -> DataFrame:
            some = dealt.filter(F.pmod(F.xxhash64("pivot", "class", "part"), F.lit(times)) == turn)
            known = marks.join(bounded(save(some.select("name").distinct(), f"{name}-names")), "name", "left_semi").groupBy("name").agg(F.first("marks").alias("marks"))
            met = some.join(known, "name").select(*keys, "guest", "name", "n", "marks").repartition("pivot", "class", "part").sortWithinPartitions("pivot", "class", "part", "guest")
            return settled(save(met.mapInArrow(by, noted_schema), name))

        return reduce(DataFrame.union, [of(turn) for turn in range(times)])

    found = narrowed(asked, narrow, "join-asked")
    lonely = found.filter("NOT may")
    if not lonely.isEmpty():
        there = save(lonely.select("pivot", "class").distinct(), "join-lonely")
        guests = lonely.withColumn("home", F.col("part")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("part != home").select(*keys, "name", "n", F.lit(True).alias("guest"))
        hosts = found.filter("parts > 1").join(bounded(there), ["pivot", "class"], "left_semi").select(*keys, "name", "n", F.lit(False).alias("guest"))
        found = found.union(narrowed(save(guests.union(hosts), "join-guests"), visit, "join-visits"))
    member = save(found.filter("may").select("name", "pivot").distinct(), "join-members")
    settle(spark)
    shown = named.groupBy("name").agg(F.min("key").alias("key"), F.first("n").alias("n"))
    member = save(member.join(shown, "name").select("name", "key", "pivot", "n"), "join-shown")
    parts = bounded(save(member.groupBy("pivot").agg(F.ceil(F.sum("n") / block_grams).cast("int").alias("parts")), "join-parts"))
    member = save(member.join(parts, "pivot").withColumn("part", F.pmod(F.xxhash64("name"), "parts").cast("int")), "join-blocks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in blocks(batches):
            s = Sets(b.column("text"), k, *frequent.value[:2])
            for place, guest, root, name, v in zip(zip(b.column("pivot").to_pylist(), b.column("part").to_pylist()), b.column("guest").to_pylist(), b.column("root").to_pylist(), s.names.tolist(), s.values):
                if place != at and held:
                    yield _link(held)
                    held = []
                at = place
                held.append((name, guest, root, v))
        if held:
            yield _link(held)

    def links(dealt: DataFrame) -> DataFrame:
        """dealt(key, pivot, part, guest, root): links within each (pivot, part) between sets of different roots; if there are guests, of these with the others."""
        dealt = save(dealt.select("key", "pivot", "part", "guest", "root", "n"), "join-dealt")
        times = max(turns(dealt, _TEXTS_AT_ONCE), min(_MOST_SCANS, math.ceil(dealt.count() / BROADCAST_ROWS)))

        def found(turn: int) -> DataFrame:
            some = dealt.filter(F.pmod(F.xxhash64("pivot", "part"), F.lit(times)) == turn).drop("n")
            moved = rows.select("key", "text").join(bounded(some), "key")
            return settled(save(moved.repartition("pivot", "part").sortWithinPartitions("pivot", "part").mapInArrow(search, "a long, b long"), "join-links"))

        return reduce(DataFrame.union, [found(turn) for turn in range(times)])

    alone, nobody = F.col("name").alias("root"), F.lit(False).alias("guest")
    edges = links(member.select("key", "pivot", "part", "n", nobody, alone))
    split = member.filter("parts > 1")
    if not split.isEmpty():
        rooted = lambda e: split.join(bounded(save(components(e), "join-roots")), F.col("name") == F.col("node"), "left").withColumn("root", F.coalesce("root", "name")).drop("node")
        first = save(rooted(edges).groupBy("pivot", "part", "root").agg(F.min(F.struct("name", "key", "n")).alias("s")).select("pivot", "root", "s.*"), "join-first")
        again = bounded(save(first.groupBy("pivot").agg(F.ceil(F.sum("n") / block_grams).cast("int").alias("parts")), "join-parts"))
        edges = edges.union(links(first.join(again, "pivot").select("key", "pivot", F.pmod(F.xxhash64("root"), "parts").cast("int").alias("part"), "n", nobody, "root")))
        now = save(rooted(edges), "join-rooted")
        main = now.groupBy("pivot", "root").agg(F.count(F.lit(1)).alias("sets")).groupBy("pivot").agg(F.max_by("root", F.struct("sets", "root")).alias("main"))
        odd = save(now.join(main, "pivot").filter("root != main").select("key", "pivot", "parts", "root", "n", F.col("part").alias("home")), "join-odd")
        guests = odd.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("part != home").select("key", "pivot", "part", "n", F.lit(True).alias("guest"), "root")
        hosts = now.join(odd.select("pivot").distinct(), "pivot", "left_semi").select("key", "pivot", "part", "n", nobody, "root")
        edges = edges.union(links(guests.union(hosts)))
    roots = bounded(save(components(edges), "join-roots"))
    settle(spark)
    group = F.coalesce("root", "name").alias("group")
    full = save(named.filter("n > 0").join(roots, F.col("name") == F.col("node"), "left").select("id", "n", group), "join-full")
    least = bounded(save(full.groupBy("group").agg(F.min("id").alias("component_id")), "join-least"))
    out = full.join(least, "group").select("id", "n", "component_id").union(named.filter("n = 0").select("id", "n", F.col("id")))
    return out.toDF(id_col, "n_shingles", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, less all but the one with the least id of each component.

    Rows that repeat id and text are one; only rows whose id repeats are shuffled
    to find them. Rows of components without any id stay, and so do rows without
    words, which link with nothing. An empty table gives an empty result; columns
    of any name are kept.
    """
    found = join_components(docs, id_col, text_col).toDF("id", "n", "component")
    found = found.filter(F.col("component").isNull() | F.col("id").eqNullSafe(F.col("component")))
    kept = save(found.groupBy("id").agg(F.count(F.lit(1)).alias("many")), "join-kept")

    def of(ids: DataFrame) -> DataFrame:
        ids = bounded(ids.select("id"))
        return docs.join(ids, docs[id_col].eqNullSafe(ids["id"]), "left_semi")

    again = kept.filter("many > 1")
    return of(kept) if again.isEmpty() else of(kept.filter("many = 1")).union(of(again).dropDuplicates([id_col, text_col]))


def _blocks(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], columns: tuple[str, ...], most: int = 1 << 62) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) for each run of equal keys in sorted batches; of a run longer than ``most``, piece by piece."""
    at, held = None, []
    for b in batches:
        for place, row in zip(zip(*[b.column(c).to_pylist() for c in keys]), zip(*[b.column(c).to_pylist() for c in columns])):
            if (place != at or len(held) >= most) and held:
                yield at, held
                held = []
            at = place
            held.append(row)
    if held:
        yield at, held


def _link(held: list[tuple[int, bool, int, np.ndarray]]) -> pa.RecordBatch:
    """A block's links, as many as join its sets (name, guest, root, set) into components; with guests, only those of guests with others."""
    held = sorted(held, key=lambda x: (x[1], len(x[3]), x[0]))
    if len(held) > 64:
        kept = may_link(np.array([len(x[3]) for x in held]), [signature(x[3]) for x in held])
        held = [x for x, may in zip(held, kept) if may]
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while up.get(i, i) != i:
            up[i] = up.get(up[i], up[i])
            i = up[i]
        return i

    tree, pairs, across = Tree(np.zeros(0, np.uint64)), [], any(x[1] for x in held)
    for i, (name, guest, own, v) in enumerate(held):
        if guest or not across:
            for j in tree.links(v, lambda j: root(own) == root(held[j][2])):
                if root(own) != root(held[j][2]):
                    up[root(own)] = root(held[j][2])
                    pairs.append((name, held[j][0]))
        if not guest:
            tree.add(v, i)
    return pa.RecordBatch.from_arrays([pa.array([p[x] for p in pairs], pa.int64()) for x in (0, 1)], ["a", "b"])
