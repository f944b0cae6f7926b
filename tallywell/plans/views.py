"""Views: pane tables that are built once, serve several queries and other views, and are evicted.

A view is a definition: which samples, by which labels, at which pane width, from
samples or from another view. Its panes are stored under the key of that
definition and their absolute end, so whoever needs the same panes finds them.
A manifest says which are there: panes are written first and the manifest
after, so a run that is lost in between leaves panes that nobody reads and the next run replaces.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from math import gcd, lcm

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..model import Unsupported
from ..operators.windows import Grid, aggregate, labelled, windowed
from ..storage import save
from . import panes as P

#: Of sums by fewer labels than the source has: the order of samples is gone, and counters with it.
PLAIN = ("n", "total", "least", "largest")


@dataclass(frozen=True)
class View:
    """``match``: label=value pairs of the samples that count. ``source``: the view whose panes this one is made of; null: the samples."""

    width: int
    labels: tuple[str, ...]
    match: tuple[tuple[str, str], ...] = ()
    source: View | None = None

    def __post_init__(self):
        s = self.source
        if s and (self.width % s.width or not set(self.labels) <= set(s.labels) or self.match != s.match):
            raise Unsupported(f"a view of {self.width} by {self.labels} from one of {s.width} by {s.labels}", "its width must be a multiple, its labels among the source's, its samples the same")

    @property
    def counters(self) -> bool:
        """The state tells how counters grew."""
        return self.source is None or (self.source.counters and set(self.labels) == set(self.source.labels))

    @property
    def state(self) -> tuple[str, ...]:
        return P.STATE if self.counters else PLAIN

    @property
    def key(self) -> str:
        said = {"width": self.width, "labels": sorted(self.labels), "match": sorted(self.match), "source": self.source and self.source.key}
        return hashlib.sha256(json.dumps(said).encode()).hexdigest()[:16]


@dataclass
class Cost:
    """What an evaluation did. panes_*: over all views it touched; samples_read: what went into new panes; samples_at_query: read besides, for panes that aren't complete."""

    views_refreshed: int = 0
    panes_built: int = 0
    panes_reused: int = 0
    panes_evicted: int = 0
    samples_read: int = 0
    samples_at_query: int = 0
    state_rows: int = 0
    state_bytes: int = 0


_MANIFEST = "view string, pane long, rows long, retention_ms long"


@dataclass
class Store:
    """Stored panes under ``root``, a folder that all executors share."""

    spark: SparkSession
    root: str
    keep: dict[str, int] = field(default_factory=dict)

    # -- the manifest ----------------------------------------------------------------------------------------------

    def manifest(self) -> DataFrame:
        """(view, pane, rows, retention_ms) of the panes that are there: a few bytes for each of them, whatever they hold."""
        if not self._there(f"{self.root}/manifest"):
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest")

    def held(self, view: View, low: int, high: int, filled: bool = False) -> list[int]:
        """Ends in (low, high] of the view's stored panes, or of those that have rows."""
        rows = self.manifest().filter((F.col("view") == view.key) & (F.col("pane") > low) & (F.col("pane") <= high) & (F.col("rows") >= int(filled)))
        return sorted(r.pane for r in rows.select("pane").distinct().collect())

    def _note(self, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    # -- panes -----------------------------------------------------------------------------------------------------

    def _path(self, view: View) -> str:
        return f"{self.root}/{view.key}"

    def read(self, view: View, samples: DataFrame, low: int, high: int) -> DataFrame:
        """(window_end, labels, state) of stored panes with ends in (low, high]: only those partitions are opened. samples tell the types if there are none."""
        ends = self.held(view, low, high, filled=True)
        if not ends:
            return _live(view, samples.filter("false"))
        df = self.spark.read.option("basePath", self._path(view)).parquet(*[f"{self._path(view)}/pane={e}" for e in ends])
        return df.select(F.col("pane").cast("long").alias("window_end"), *view.labels, *view.state)

    def refresh(self, view: View, samples: DataFrame, low: int, high: int, retention_ms: int, cost: Cost) -> None:
        """Builds the panes with ends in (low, high] that aren't stored; those of the source first. low and high are multiples of the width.

        One write job, of samples (or source panes) of the missing stretch alone; each pane is a partition that the job replaces.
        """
        if view.source:
            self.refresh(view.source, samples, low, high, retention_ms, cost)
        have = set(self.held(view, low, high))
        missing = [e for e in range(low + view.width, high + 1, view.width) if e not in have]
        cost.panes_reused += len(have)
        if not missing:
            return
        for r in self._counted(view, missing).collect():  # left by a run that was lost before it noted them
            self._delete(f"{self._path(view)}/pane={r.pane}")
        stretches = _stretches(missing, view.width)
        seen = Observation()
        if view.source:
            built = self._from_source(view, samples, stretches)
        else:
            built = P.build(labelled(samples, **dict(view.match)).filter(_within("ts_ms", stretches)).observe(seen, F.count(F.lit(1)).alias("n")), view.width, view.labels)
        built = built.withColumnRenamed("window_end", "pane").select("pane", *view.labels, *view.state)
        # a large pane is dealt to several tasks by its labels
        built.repartition("pane", *view.labels).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pane").parquet(self._path(view))
        if not view.source:
            cost.samples_read += _counted_rows(seen)
        cost.views_refreshed += 1
        cost.panes_built += len(missing)
        ends = self.spark.createDataFrame([(view.key, e, retention_ms) for e in missing], "view string, pane long, retention_ms long")
        counts = self._counted(view, missing)
        self._note(ends.join(counts, "pane", "left").select("view", "pane", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "retention_ms"))

    def _counted(self, view: View, ends: list[int]) -> DataFrame:
        """(pane, rows) of what is in these panes' folders; no column of them is read."""
        if not self._there(self._path(view)):
            return self.spark.createDataFrame([], "pane long, rows long")
        there = self.spark.read.schema("pane long").parquet(self._path(view))
        asked = self.spark.createDataFrame([(e,) for e in ends], "pane long")
        return there.filter((F.col("pane") >= ends[0]) & (F.col("pane") <= ends[-1])).join(F.broadcast(asked), "pane", "left_semi").groupBy(F.col("pane").cast("long").alias("pane")).agg(F.count(F.lit(1)).alias("rows"))

    def _from_source(self, view: View, samples: DataFrame, stretches: Sequence[tuple[int, int]]) -> DataFrame:
        source = self.read(view.source, samples, stretches[0][0], stretches[-1][1]).filter(_within("window_end", stretches))
        if view.counters:
            return P.roll_up(source, view.width, view.labels)
        return _sums(source.withColumn("window_end", P.window_end(F.col("window_end"), view.width)), ["window_end", *view.labels])

    def evict(self, now_ms: int) -> int:
        """Deletes the panes that end at or before now - retention of all who have asked for them; the manifest forgets them first."""
        known = self.manifest().groupBy("view", "pane").agg(F.max("rows").alias("rows"), F.max("retention_ms").alias("retention_ms")).collect()
        old = [r for r in known if r.pane <= now_ms - max(r.retention_ms, self.keep.get(r.view, 0))]
        if not old:
            return 0
        rest = [tuple(r) for r in known if r not in old]
        self.spark.createDataFrame(rest, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest-next")
        self._move(f"{self.root}/manifest-next", f"{self.root}/manifest")
        for r in old:
            self._delete(f"{self.root}/{r.view}/pane={r.pane}")
        return len(old)

    def size(self) -> tuple[int, int]:
        """(rows, bytes) of the panes in the manifest."""
        rows = self.manifest().agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        size = 0
        for (key,) in self.manifest().filter("rows > 0").select("view").distinct().collect():
            files = self.spark.read.parquet(f"{self.root}/{key}").select("_metadata.file_path", "_metadata.file_size").distinct()
            size += files.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]
        return rows, size

    def _there(self, path: str) -> bool:
        fs, p = self._files(path)
        return fs.exists(p)

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _delete(self, path: str) -> None:
        fs, p = self._files(path)
        fs.delete(p, True)

    def _move(self, source: str, to: str) -> None:
        """Between the two steps there is no manifest: panes are then built again, never read wrongly."""
        self._delete(to)
        fs, p = self._files(source)
        fs.rename(p, self._files(to)[1])

    # -- evaluation ------------------------------------------------------------------------------------------------

    def merged(self, view: View, samples: DataFrame, grid: Grid, range_ms: int, complete_to: int | None = None, retention_ms: int | None = None) -> tuple[DataFrame, Cost]:
        """(t, labels, state) over each (t - range, t], and what it cost.

        Panes that end by ``complete_to`` are taken from the store, where those that
        are missing are built; later ones may get more samples, and are built for
        this answer only. Panes that no evaluation after this one needs for ``retention_ms`` (the range, if not given) are evicted.
        """
        w, cost = view.width, Cost()
        if range_ms % w or grid.first % w or grid.step % w:
            raise Unsupported(f"range {range_ms} at {grid.first} + n * {grid.step}", f"panes are {w} wide")
        last = grid.first + (grid.last - grid.first) // grid.step * grid.step
        low, high = grid.first - range_ms, last
        stored = high if complete_to is None else max(low, min(high, complete_to // w * w))
        keep = range_ms if retention_ms is None else max(range_ms, retention_ms)
        self.keep[view.key] = max(self.keep.get(view.key, 0), keep)
        if stored > low:
            self.refresh(view, samples, low, stored, keep, cost)
        panes, seen = self.read(view, samples, low, stored), Observation()
        if high > stored:
            fresh = labelled(samples, **dict(view.match)).filter(_within("ts_ms", [(stored, high)])).observe(seen, F.count(F.lit(1)).alias("n"))
            panes = panes.unionByName(_live(view, fresh))
        got = P.merge(panes, w, grid, range_ms, view.labels) if view.counters else _sums(windowed(panes, grid, range_ms, "window_end"), ["t", *view.labels])
        got = save(got, "view-answer")  # before its panes may go
        if high > stored:
            cost.samples_at_query = _counted_rows(seen)
        cost.panes_evicted = self.evict(last)
        cost.state_rows, cost.state_bytes = self.size()
        return got, cost


def _counted_rows(seen: Observation) -> int:
    """What the observation counted; where there was nothing to count, the plan was cut short and has no counter."""
    try:
        return seen.get["n"]
    except Py4JJavaError:
        return 0


def _within(ts: str, stretches: Sequence[tuple[int, int]]):
    """A plain range on the stored column for each stretch, which reaches the scan."""
    each = [(F.col(ts) > a) & (F.col(ts) <= b) for a, b in stretches]
    out = each[0]
    for e in each[1:]:
        out = out | e
    return out


def _stretches(ends: Sequence[int], width: int) -> list[tuple[int, int]]:
    """(low, high] of neighbouring panes together."""
    out: list[tuple[int, int]] = []
    for e in ends:
        if out and out[-1][1] == e - width:
            out[-1] = (out[-1][0], e)
        else:
            out.append((e - width, e))
    return out


def _sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("largest").alias("largest"))


def _live(view: View, samples: DataFrame) -> DataFrame:
    """The view's panes straight from samples."""
    first = view
    while first.source:
        first = first.source
    if view.counters:
        return P.build(samples, view.width, view.labels)
    return _sums(P.build(samples, view.width, first.labels), ["window_end", *view.labels])


# -- sharing -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Over:
    """A windowed query: ``how`` over ``range_ms`` for each series, and then ``by``, if it is given, of the series' values."""

    name: str
    how: str
    range_ms: int
    step: int
    series: tuple[str, ...]
    match: tuple[tuple[str, str], ...] = ()
    by: tuple[str, ...] | None = None
    aggregate: str = "sum"

    @property
    def fingerprint(self) -> str:
        """Equal for queries whose panes can be the same: the same samples by the same series."""
        return hashlib.sha256(json.dumps({"series": sorted(self.series), "match": sorted(self.match)}).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Shared:
    """One view and the queries that it serves."""

    view: View
    queries: tuple[Over, ...]
    retention_ms: int
    #: Every so many milliseconds all of them are due.
    together: int


def share(queries: Sequence[Over], origin: int = 0) -> list[Shared]:
    """Queries with one fingerprint share a view, at the widest panes that all their ranges and steps are made of.

    A wider pane is fewer rows to store and to merge: the width is the greatest
    common divisor of ranges, steps and the grid's origin, and the queries meet at the least common multiple of their steps.
    """
    groups: dict[str, list[Over]] = {}
    for q in queries:
        groups.setdefault(q.fingerprint, []).append(q)
    out = []
    for own in groups.values():
        width = gcd(origin, *[q.range_ms for q in own], *[q.step for q in own])
        view = View(width, own[0].series, tuple(sorted(own[0].match)))
        out.append(Shared(view, tuple(own), max(q.range_ms for q in own), lcm(*[q.step for q in own])))
    return out


def report(spark: SparkSession, plans: Sequence[Shared]) -> DataFrame:
    """(query, view, width, panes, together, shared_by): what each query reads, and with how many it shares it."""
    rows = [(q.name, s.view.key, s.view.width, q.range_ms // s.view.width, s.together, len(s.queries)) for s in plans for q in s.queries]
    return spark.createDataFrame(rows, "query string, view string, width long, panes long, together long, shared_by long")


_FROM_STATE = {"sum": "total", "count": "n", "min": "least", "max": "largest"}


def answer(store: Store, plan: Shared, query: Over, samples: DataFrame, grid: Grid, complete_to: int | None = None) -> tuple[DataFrame, Cost]:
    """(t, labels, value) of a query from its shared view."""
    # the other queries of the view may ask for what this one's grid asks
    state, cost = store.merged(plan.view, samples, grid, query.range_ms, complete_to, plan.retention_ms + grid.last - grid.first)
    if query.how in ("rate", "increase"):
        got = P.increase_of(state, query.range_ms, query.series, query.how == "rate")
    elif query.how == "avg":
        got = state.select("t", *query.series, (F.col("total") / F.col("n")).alias("value"))
    elif query.how in _FROM_STATE:
        got = state.select("t", *query.series, F.col(_FROM_STATE[query.how]).cast("double").alias("value"))
    else:
        raise Unsupported(f"{query.how}_over_time from panes", "not one of sum, count, avg, min, max, rate, increase")
    return (got if query.by is None else aggregate(got, query.aggregate, query.by)), cost
