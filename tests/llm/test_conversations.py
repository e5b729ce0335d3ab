"""Conversation repair against a plain recursion over whole conversations."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import cache

import pytest

from panelyard.llm import conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string, at string, conv string, step string"
sys.setrecursionlimit(20_000)
SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


LEGAL = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def plain_best(rows, faults):
    """(cost, letters, roles and texts) of the least (cost, letters), by recursion from the end; more than two insertions in one place never pay."""

    @cache
    def best(i, state, left=2):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        options = [("I", 5, role, "") for role in ("user", "assistant") if left]
        if i < len(rows):
            _, _, role, text = rows[i]
            options.append(("D", 2, None, ""))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                options += [("K", more, role, text)] + [("R", 1 + more, r, text) for r in ("user", "assistant")]
        for letter, cost, new, text in options:
            if new is None or (state, new[:1]) in LEGAL:
                rest = best(*((i, new[:1], left - 1) if letter == "I" else (i + 1, state if new is None else new[:1])))
                if rest[0] < 10**9:
                    found.append((cost + rest[0], letter + rest[1], (((new, text),) if new is not None else ()) + rest[2]))
        return min(found, key=lambda x: x[:2], default=(10**9, "", ()))

    return best(0, "")


def plain_report(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]]
    for r in plain_damage(rows):
        groups[r[0]].append(r)
    out = {}
    for conv, mine in groups.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        turns = [t for _, t, _, _ in mine if t is not None]
        seen, faults = set(), []
        for _, _, role, text in mine:
            end = text.rstrip(SPACE)[-1:]
            faults.append("blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if end not in (".", "!", "?") else "")
            seen.add((role, text))
        initials = [r[2][:1] for r in mine]
        cost, letters, stay = plain_best(tuple(mine), tuple(faults))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in stay).encode()).hexdigest(),
        )
    return out


def made_up(n, seed, longest=9):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in sorted(r.sample(range(40), r.randrange(1, longest))):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = r.choice(["Hello there.", "Same words!", "cut off here", "", " \n\t", "What is it?", f"Text {r.random()}.", f"Open {r.random()}", None, "ends. \x0b\r\n", "line\nbreak. then"])
            rows.append((conv, turn, role, text))
    return rows


def report(spark, rows):
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = conversations.repair_report(table).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:] for r in got}


@pytest.mark.parametrize("bits", [12, 1])
def test_against_plain_recursion(spark, monkeypatch, bits):
    """Pieces of two rows give what whole conversations give."""
    monkeypatch.setattr(conversations, "PIECE_BITS", bits)
    rows = made_up(400, bits)
    assert report(spark, rows) == plain_report(rows)


def test_one_long_conversation_among_others(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE_BITS", 4)
    r = random.Random(3)
    rows = made_up(30, 9) + [(1000, t, r.choice(["user", "assistant", "system", "user"]), f"Row {t % 70}" + r.choice([".", "", "!"])) for t in range(600)]
    assert report(spark, rows) == plain_report(rows)


def test_odd_rows(spark):
    """Null ids and turns, a conversation that loses all rows, one of one system turn, a long text, and an empty table."""
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (lost, 0, "user", "Gone."), (2000, None, "system", "Be kind."), (2001, 1, "user", "Long " * 200_000 + "."), (2001, None, "assistant", "Null turn first.")]
    got = report(spark, rows)
    assert got == plain_report(rows)
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", conversations.EMPTY_SHA)
    assert report(spark, []) == {}


def test_rows_that_repeat_a_turn(spark):
    """Repeated rows are alike, so the first stays and the others are duplicates."""
    rows = [(5, 1, "user", "Hi."), (5, 1, "user", "Hi."), (5, 2, "assistant", "Yes.")] * 3
    assert report(spark, rows)[5][2] >= 6


def test_repaired_rows(spark):
    rows = made_up(200, 21)
    turns = conversations.ordered(conversations.damaged(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)))
    out = conversations.repaired(turns, conversations.edits(conversations.faults(turns))).orderBy("conv", "at", "step").collect()
    texts = defaultdict(str)
    for r in out:
        texts[r["conv"]] += r["role"][:1]
        assert r["edit"] in "KRI" and (r["edit"] != "I" or r["text"] == "")
    assert texts and all(re.fullmatch("s?(ua)+", t) for t in texts.values())
