"""Conversation repair: an input acceptor, an edit transducer and a grammar of roles, composed as far as they are reached.

The weight of a path is (cost, labels), the least of two being the cheaper and
then the one that ASCII sorts first. Every label says whether it takes a row, and
the grammar says which role an inserted or changed row gets, so a string of labels
leads from a state to one state only; paths between the same two states over the same rows never are
beginnings of each other at the same cost, and the least weight of a whole is made of
least weights of its parts. Conversations are therefore cut anywhere, and parts are composed.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import save

#: (s?(ua)+)? over initials of roles: state -> initial -> state. 1 follows s, 2 follows u, 3 follows a.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows of a part: what is composed at once.
_PART = 512

Weights = dict[int, tuple[int, str]]


def _less(to: Weights, state: int, weight: tuple[int, str]) -> bool:
    if state not in to or weight < to[state]:
        to[state] = weight
        return True
    return False


def _insert(at: Weights) -> Weights:
    """With rows inserted; a state that is reached cheaper so is left anew. Inserting in a circle costs, so this ends."""
    todo = list(at)
    while todo:
        cost, labels = at[state := todo.pop()]
        todo += [to for role, to in GRAMMAR[state].items() if role in ROLES and _less(at, to, (cost + INSERT, labels + "I"))]
    return at


def _step(at: Weights, symbol: str) -> Weights:
    """Past a row. symbol: the initial of its role, upper case if the row is truncated; - for a row that must go."""
    after: Weights = {}
    more = TRUNCATED if symbol.isupper() else 0
    for state, (cost, labels) in at.items():
        _less(after, state, (cost + DELETE, labels + "D"))
        if symbol == "-":
            continue
        for role, to in GRAMMAR[state].items():
            if role == symbol.lower():
                _less(after, to, (cost + KEEP + more, labels + "K"))
            if role in ROLES:
                _less(after, to, (cost + REROLE + more, labels + "R"))
    return _insert(after)


@functools.lru_cache(1 << 13)
def compose(symbols: str, start: int) -> tuple[tuple[int, int, str], ...]:
    """(state, cost, labels): the least weights over a part, from one state to each that is reached."""
    at = _insert({start: (0, "")})
    for x in symbols:
        at = _step(at, x)
    return tuple((state, *weight) for state, weight in at.items())


def cheapest(parts: list[str]) -> tuple[int, str]:
    """(cost, labels) of the cheapest repair of a conversation, of which these are the parts."""
    at: Weights = {0: (0, "")}
    for symbols in parts:
        after: Weights = {}
        for state, (cost, labels) in at.items():
            for to, more, last in compose(symbols, state):
                _less(after, to, (cost + more, labels + last))
        at = after
    return min(at[state] for state in ENDS if state in at)


# -- damage --------------------------------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with repeatable damage, by crc32 of ``conv_id:turn`` modulo 20: 0 drops
    the row, 1 empties its text, 2 removes [.!?] from it, 3 repeats it, 4 makes its role user. Null values are a space,
    ids and turns in that key only. ``copies`` says how often a row is there, 0 included."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


# -- faults and audits ---------------------------------------------------------------------------------------------

_ORDER = ("conv_id", "turn", "role", "digest")


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def _marks(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, copies, symbol, blank, truncated, first): equal rows of a turn are one; first: nothing like it came before."""
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    light = rows.select("conv_id", "turn", "role", _digest().alias("digest"), "copies", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"), F.lit(False).alias("first"))
    seen = light.filter("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("at"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    heads = seen.select("conv_id", F.col("at.turn").alias("turn"), "role", "digest", F.lit(0).alias("copies"), "blank", "truncated", F.lit(True).alias("first"))
    return light.union(heads).groupBy(*_ORDER).agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"), F.max("first").alias("first"))


_FIELDS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")
_LEGAL = frozenset(("su", "ua", "au"))


def _initial(role: str) -> str:
    """x stands for an empty role and for every initial that the grammar doesn't have."""
    return role[:1] if role[:1] in tuple("sua") else "x"


def _parts(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Marks in order -> parts of conversations: symbols, counts, and what is at their seams."""
    task, done = TaskContext.get().partitionId() << 32, []
    now: dict | None = None

    def fresh(conv) -> dict:
        return {"conv_id": conv, "symbols": [], "first_turn": None, "last_turn": None, "first_role": "", "last_role": "", **dict.fromkeys(_FIELDS, 0)}

    def flush() -> pa.RecordBatch:
        for i, d in enumerate(done):
            d["part"] = task + flush.sent + i
        flush.sent += len(done)
        names = ["conv_id", "part", "symbols", "first_turn", "last_turn", "first_role", "last_role", *_FIELDS]
        types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * len(_FIELDS)]
        out = pa.RecordBatch.from_arrays([pa.array(["".join(d[n]) if n == "symbols" else d[n] for d in done], t) for n, t in zip(names, types)], names)
        done.clear()
        return out

    flush.sent = 0
    for b in batches:
        for conv, turn, role, copies, blank, truncated, first in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "copies", "blank", "truncated", "first"))):
            if now is None or now["conv_id"] != conv:
                if now is not None:
                    done.append(now)
                now = fresh(conv)
            for i in range(copies):
                if len(now["symbols"]) == _PART:
                    done.append(now)
                    now = fresh(conv)
                if len(done) >= 4096:
                    yield flush()
                initial = _initial(role)
                fault = "blank" if blank else "duplicate" if i or not first else "truncated" if truncated else ""
                now["symbols"].append("-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
                if fault:
                    now[fault] += 1
                if now["rows"]:
                    now["illegal"] += now["last_role"] + initial not in _LEGAL
                else:
                    now["first_role"], now["first_turn"] = initial, turn
                if turn is not None and turn != now["last_turn"]:
                    now["turns"] += 1
                    now["last_turn"] = turn
                    now["first_turn"] = turn if now["first_turn"] is None else now["first_turn"]
                now["last_role"] = initial
                now["rows"] += 1
    if now is not None:
        done.append(now)
    if done:
        yield flush()


def _fold(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, from its parts in order."""
    for b in batches:
        out = []
        for conv, parts in zip(b.column("conv_id").to_pylist(), b.column("parts").to_pylist()):
            parts = [p for p in parts if p["rows"]]
            total = {f: sum(p[f] for p in parts) for f in _FIELDS}
            for p, q in zip(parts, parts[1:]):
                total["illegal"] += p["last_role"] + q["first_role"] not in _LEGAL
                total["turns"] -= p["last_turn"] is not None and p["last_turn"] == q["first_turn"]
            turns = [t for p in parts for t in (p["first_turn"], p["last_turn"]) if t is not None]
            cost, audit = cheapest([p["symbols"] for p in parts])
            out.append((conv, max(turns) - min(turns) + 1 - total["turns"] if turns else 0, total["blank"], total["duplicate"], total["truncated"], total["illegal"], cost, audit))
        types = [id_type, *[pa.int64()] * 6, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audit(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, copies) -> (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row for each conversation.

    A conversation's rows are in order of turn, nulls first, then role, then the
    text's SHA-256; copies of a row are next to each other, and a row of no copies
    names its conversation only. Counts and audits are of the first fault of each
    row: blank, duplicate (same role and text earlier in the conversation), truncated.
    audit: the edits of the cheapest repair, D, I, K or R each; of equally cheap ones
    the string that ASCII sorts first.

    No text moves: rows are marked where they lie, equal ones are added up before
    they are dealt, and the first of each kind is found the same way. Marks are
    dealt by ranges of (conversation, turn, ...), so that a conversation of any length is
    spread, and cut to parts of 512 rows; parts go to their conversation, whose audit is one value, as long as it has rows.

    A null id is a conversation like any other. Null roles, texts and counts must
    be gone (``damaged`` makes them a space). A role is told by its first letter;
    one that doesn't begin with s, u or a can't be kept as it is. An empty table gives no rows.
    """
    id_type = pa.int64() if rows.schema["conv_id"].dataType.typeName() in ("long", "integer", "short", "byte") else pa.string()
    kind = "long" if id_type == pa.int64() else "string"
    rows = rows.withColumns({"conv_id": F.col("conv_id").cast(kind), "turn": F.col("turn").cast("long")})
    marks = _marks(rows).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).drop("digest")
    counts = ", ".join(f"{f} long" for f in _FIELDS)
    parts = save(marks.mapInArrow(lambda it: _parts(it, id_type), f"conv_id {kind}, part long, symbols string, first_turn long, last_turn long, first_role string, last_role string, {counts}"), "conversation-parts")
    of = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "symbols", "first_turn", "last_turn", "first_role", "last_role", *_FIELDS))).alias("parts"))
    return of.mapInArrow(lambda it: _fold(it, id_type), f"conv_id {kind}, {REPORT}")


# -- repaired rows -------------------------------------------------------------------------------------------------


def _apply(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation behind its audit -> repaired rows."""
    out: list[tuple] = []
    conv = audit = None
    at = place = state = 0

    def put(role: str, text: str, label: str) -> None:
        nonlocal place, state
        state = GRAMMAR[state][role[:1]]
        out.append((conv, place, role, text, label))
        place += 1

    def forced() -> str:
        return next(ROLES[r] for r in GRAMMAR[state] if r in ROLES)

    def inserts() -> None:
        nonlocal at
        while audit is not None and audit[at : at + 1] == "I":
            put(forced(), "", "I")
            at += 1

    def flush() -> pa.RecordBatch:
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string()]
        b = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], ["conv_id", "place", "role", "text", "edit"])
        out.clear()
        return b

    for b in batches:
        for c, plan, role, text, copies in zip(*(b.column(n).to_pylist() for n in ("conv_id", "audit", "role", "text", "copies"))):
            if plan is not None:
                inserts()
                conv, audit, at, place, state = c, plan, 0, 0, 0
                continue
            for _ in range(copies):
                inserts()
                label = audit[at]
                at += 1
                if label != "D":
                    put(role if label == "K" else forced(), text, label)
        yield flush()
    inserts()
    yield flush()


def repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the rows of the conversations after the cheapest repair, in order within a partition.

    rows and report: as ``audit`` takes and gives them. Texts move once, to their
    conversation, behind its audit, and stream through it in order: no
    conversation is held. A conversation of which nothing is left has no rows.
    """
    kind = report.schema["conv_id"].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else pa.string()
    none = lambda t: F.lit(None).cast(t)
    order = ["conv_id", "turn", "role", "digest"]
    texts = rows.filter("copies > 0").select(F.col("conv_id").cast(kind).alias("conv_id"), F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", _digest().alias("digest"), "text", "copies", none("string").alias("audit"))
    plans = report.select("conv_id", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("digest"), none("string").alias("text"), F.lit(0).alias("copies"), "audit")
    together = plans.union(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *order[1:])
    return together.select("conv_id", "audit", "role", "text", "copies").mapInArrow(lambda it: _apply(it, id_type), f"conv_id {kind}, place long, role string, text string, edit string")


def _lines(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    conv, digest, done = None, None, []
    for b in batches:
        for c, place, role, text in zip(*(b.column(n).to_pylist() for n in ("conv_id", "place", "role", "text"))):
            if place == 0:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            digest.update(f"{'' if place == 0 else chr(10)}{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], id_type), pa.array([d[1] for d in done], pa.string())], ["conv_id", "sha256"])
        done = []
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], id_type), pa.array([digest.hexdigest()])], ["conv_id", "sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha256) of ``repaired``'s own result: of each conversation's ``role:text``, joined by line ends. It follows the partitions and moves nothing."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    return repaired.mapInArrow(lambda it: _lines(it, pa.int64() if kind == "bigint" else pa.string()), f"conv_id {kind}, sha256 string")
