"""Secret scans over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bounded, fresh_path, save
from .words import blocks

#: Kind, pattern, group whose length counts, least length. A new rule or a changed one needs a new RULES_VERSION.
RULES_VERSION = 1
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind as listed.

    For each kind, leftmost non-overlapping matches, of which those with a long enough value stay.
    """
    found = []
    for rank, (kind, pattern, group, least) in enumerate(RULES):
        if kind == "access" and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


LEDGER = "blob string, rule_version int, kinds array<string>, starts array<int>, ends array<int>"


def _scan(batches: Iterator[pa.RecordBatch], version: int) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches):
        found = [scan_text(s) for s in b.column("text").to_pylist()]
        columns = [[[x[i] for x in f] for f in found] for i in range(3)]
        yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array([version] * len(found), pa.int32()), pa.array(columns[0], pa.list_(pa.string())), pa.array(columns[1], pa.list_(pa.int32())), pa.array(columns[2], pa.list_(pa.int32()))], ["blob", "rule_version", "kinds", "starts", "ends"])


def scan_secrets(versions: DataFrame, ledger: str | None = None, path_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", rule_version: int = RULES_VERSION) -> DataFrame:
    """Findings for each row of ``versions``: the path columns, blob (SHA-256 of the text), kinds, starts, ends.

    versions: a row for each historical version of each path. ledger: folder of
    a Parquet table that holds the findings of every (blob, rule version) ever
    scanned; a run scans the pairs it lacks, appends them, and joins findings
    back to all paths. None: a new ledger in the shared folder.

    Each distinct text is scanned once, at the row that represents its blob: the
    smallest path among equals, found by partial aggregation over (blob, path).
    Representatives are told by a hash of path and blob. While those still to be
    scanned are few (``BROADCAST_ROWS``) texts are scanned where they lie; beyond,
    they move once, in that join. Findings go back to paths by blob, where hot
    blobs are split by the adaptive skew join. An append is one write job; a run that is lost before it commits
    appends nothing, and scanning a pair twice does no harm: equal rows of the
    ledger are read once.

    Null text counts as empty and has no findings. Rows with null or repeated
    paths are rows like any other: a representative is the path columns and the
    blob together, and where a row repeats both, each of its repeats is scanned and
    appended. An empty table gives an empty result. Other columns are not looked
    at. The ledger finds what the rules find, sooner: it has no spans of its own
    to add to theirs.
    """
    spark = versions.sparkSession
    ledger = ledger or fresh_path(spark, "ledger")
    text = F.coalesce(versions[text_col].cast("string"), F.lit(""))
    paths = [versions[c] for c in path_cols]
    path = F.concat_ws("/", *[F.when(c.isNull(), "-").otherwise(F.concat(F.lit("+"), c.cast("string"))) for c in paths])
    named = versions.select(*paths, path.alias("path"), F.sha2(text, 256).alias("blob"))
    index = save(named, "secret-paths")
    try:
        known = spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rule_version") == rule_version)
    except AnalysisException as e:  # no ledger yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], LEDGER)
    todo = index.groupBy("blob").agg(F.min("path").alias("path")).join(known.select("blob"), "blob", "left_anti")
    # the version itself, path and blob together: null or much revised paths must not meet each of their versions
    version = F.xxhash64("path", "blob").alias("version")
    todo = save(todo.select(version).distinct(), "secret-versions")
    rows = versions.select(path.alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text")).select(version, "blob", "text")
    rows = rows.join(bounded(todo), "version", "left_semi").select("blob", "text")
    rows.mapInArrow(lambda it: _scan(it, rule_version), LEDGER).write.mode("append").parquet(ledger)
    found = spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rule_version") == rule_version).filter(F.size("kinds") > 0).dropDuplicates(["blob"])
    empty = lambda t: F.array().cast(t)
    return index.join(found, "blob", "left").select(*path_cols, "blob", F.coalesce("kinds", empty("array<string>")).alias("kinds"), F.coalesce("starts", empty("array<int>")).alias("starts"), F.coalesce("ends", empty("array<int>")).alias("ends"))
