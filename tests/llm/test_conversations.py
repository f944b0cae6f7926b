"""Conversation repair against a plain version: damage, faults, and the cheapest edits by search over whole strings."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallywell.llm import conversations as C

COLUMNS = "conv_id long, turn long, role string, text string, copies string, digest string, part int, place int, audit string, kind int"


def talks() -> list[tuple]:
    """Talks with nulls in any column, blank and cut texts, odd roles, repeated rows and turns, one of many rows, and one whose rows all go."""
    r = random.Random(11)
    texts = ["Yes.", "No?", "Well!", "Yes", "cut off", "  ", "", None, "end.\n", "odd\u0085", "a. ", "No?\t \r"]
    out = []
    for c in range(260):
        n = r.choice([1, 2, 3, 4, 6, 9])
        for t in range(n):
            role = r.choice(["user", "assistant"]) if r.random() < 0.4 else ("user", "assistant")[t % 2] if r.random() < 0.9 else r.choice(["system", None, "", "User", "umpire", "tool"])
            out.append((c, None if r.random() < 0.05 else t * r.choice([1, 1, 2]), "system" if t == 0 and r.random() < 0.4 else role, r.choice(texts) if r.random() < 0.5 else f"Turn {t} of {c}."))
    out += [(None, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(9)] + [(None, None, None, None), (None, None, "user", "x")]
    out += [(7777, t // 2, r.choice(["user", "assistant"]), r.choice(["Same.", f"{t}.", f"{t}"])) for t in range(1700)]
    gone = next(c for c in itertools.count(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    out += [(gone, 0, "user", "Gone."), out[5], out[5], out[30]]
    return [x + ("c", "d", 1, 2, "e", 3) for x in out]


def after_damage(rows):
    space = lambda x: " " if x is None else str(x)
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = space(role), space(text)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(faults):
    """Uniform-cost search over (cost, audit, rows so far, roles so far); no states are merged but those of equal rows and last role."""
    heap, best = [(0, "", 0, "", ())], None
    grammar = re.compile("(s?(ua)*u?)?")
    seen = set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(faults) and (roles == "" or re.fullmatch("s?(ua)+", roles)):
            return cost, audit, out
        where = (i, roles[-1:], bool(roles))
        if where in seen:
            continue
        seen.add(where)
        moves = [("I", 2, w, "", 0) for w in ("user", "assistant")]
        if i < len(faults):
            role, text, fault = faults[i]
            moves.append(("D", 3, None, "", 1))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                moves += [("K", more, role, text, 1)] * bool(role) + [("R", 2 + more, w, text, 1) for w in ("user", "assistant")]
        for label, c, role, text, n in moves:
            then = roles + role[0] if role else roles
            if grammar.fullmatch(then):
                heapq.heappush(heap, (cost + c, audit + label, i + n, then, out + ((role, text),) if role else out))
    return best


def plain(rows):
    by = {c: [] for c, *_ in rows}
    for conv, turn, role, text in after_damage(rows):
        by[conv].append(((turn is not None, turn or 0), role, hashlib.sha256(text.encode()).digest(), turn, text))
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda x: x[:3])
        seen, faults = set(), []
        for _, role, _, _, text in own:
            core = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append((role, text, "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = [x[3] for x in own if x[3] is not None]
        count = lambda f: sum(x[2] == f for x in faults)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:]))
        cost, audit, lines = cheapest(faults)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha)
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(talks(), COLUMNS).repartition(5).cache()


def test_damage(table):
    got = table.transform(C.damaged).collect()
    assert sorted(map(repr, (tuple(r)[:4] for r in got for _ in range(r.copies)))) == sorted(map(repr, after_damage(talks())))


@pytest.mark.parametrize("part", [512, 3])
def test_audits_and_repairs(spark, table, part, monkeypatch):
    monkeypatch.setattr(C, "_PART", part)
    rows = C.damaged(table)
    report = C.audit(rows).cache()
    fixed = C.repaired(rows, report)
    sha = {r.conv_id: r.sha256 for r in C.digests(fixed).collect()}
    got = {r.conv_id: (*tuple(r)[1:], sha.get(r.conv_id, hashlib.sha256(b"").hexdigest())) for r in report.collect()}
    assert report.count() == len(got)
    want = plain(talks())
    wrong = {k: (got.get(k), want[k]) for k in want if got.get(k) != want[k]}
    assert not wrong and len(got) == len(want)
    assert len(want[7777][6]) > 1500
    lines = fixed.filter("conv_id = 7777").orderBy("place").collect()
    assert [r.place for r in lines] == list(range(len(lines))) and re.fullmatch("s?(ua)*", "".join(r.role[0] for r in lines))
    assert {r.edit for r in fixed.select("edit").distinct().collect()} == {"K", "R", "I"}


def test_parts_compose():
    """Cut anywhere, the cheapest repair is the same; and it is that of a search over strings."""
    r = random.Random(2)
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "-": "user"}
    for _ in range(400):
        symbols = "".join(r.choice("suaUA-x" if r.random() < 0.6 else "suaSUAX-x") for _ in range(r.randint(0, 9)))
        whole = C.cheapest([symbols])
        cut = sorted(r.randint(0, len(symbols)) for _ in range(3))
        assert C.cheapest([symbols[a:b] for a, b in zip([0, *cut], [*cut, len(symbols)])]) == whole
        faults = [(names[x.lower()], "t", "blank" if x == "-" else "truncated" if x.isupper() else "") for x in symbols]
        assert cheapest(faults)[:2] == whole


def test_nothing(spark, table):
    none = C.damaged(table.filter("false"))
    report = C.audit(none)
    assert report.count() == 0 and C.repaired(none, report).count() == 0 and C.digests(C.repaired(none, report)).count() == 0
    gone = C.damaged(table).filter("conv_id >= 10000")
    assert tuple(C.audit(gone).first())[1:] == (0, 0, 0, 0, 0, 0, "") and F is not None
