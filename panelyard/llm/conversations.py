"""Conversation structure repair: the cheapest edits that make a conversation's roles regular, in a fixed order of ties.

A row is kept, given another role, deleted, or preceded by an inserted empty turn, so that what stays reads
system? (user assistant)+ or nothing. These edits are the arcs of a layered graph over (row, state). Forward and
backward minimum costs show which arcs are tight, that is, on some cheapest path; a frontier of states then walks along
tight arcs and takes the edit whose letter is least at each step.

A conversation may be of any length, so its rows are dealt by ranges into pieces of at most ``PIECE`` rows. A piece is
a short string of symbols and acts on costs as a 4 x 4 matrix of sums and minima; forward and backward costs at the
pieces' edges come from streams over the pieces, and the walks within pieces run apart from one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm import scratch

#: Rows of a piece, as a power of two.
PIECE_BITS = 12
KEEP_COST, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
MODULUS = 20
#: States are the start, after the system turn, after a user turn and after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: What a kept row may be in each state, and what a row that is inserted or gets another role is.
KEPT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
INITIAL = {USER: "u", ASSISTANT: "a"}
FAR = 1 << 60
ENDS = (0, FAR, FAR, 0)
#: A row's symbol: its role's initial (x for any other) and fault; rows to delete are all alike but for the initial.
SYMBOLS = {chr(ord("a") + 3 * i + j): (role, fault) for i, role in enumerate("suax") for j, fault in enumerate(("", "delete", "truncated"))}
SPACE, BLANK, ENDING = r"\x20\x09-\x0D", r"^[\x20\x09-\x0D]*$", r"[.!?][\x20\x09-\x0D]*$"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def arcs(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of every edit that uses up a row in a state."""
    role, fault = SYMBOLS[symbol]
    out = [("D", DELETE, state)]
    if fault != "delete":
        more = TRUNCATED if fault else 0
        if role in KEPT[state]:
            out.append(("K", KEEP_COST + more, KEPT[state][role]))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


def _least(costs: list[int]) -> tuple[tuple[int, ...], int]:
    low = min(costs)
    return tuple(c - low if c < FAR else FAR for c in costs), low


@cache
def before(symbol: str | None, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs to go in front of a row, insertions there included, from those behind it; None stands for the end. Less their least, which comes beside."""
    costs = [min(cost + after[to] for _, cost, to in arcs(symbol, q)) if symbol else after[q] for q in STATES]
    for _ in STATES:
        costs = [min(costs[q], INSERT + costs[NEXT[q]]) for q in STATES]
    return _least(costs)


@cache
def behind(symbol: str, front: tuple[int, ...]) -> tuple[tuple[int, ...], int, tuple[int, ...]]:
    """Costs from the start behind a row, from those in front of it, and those in front with insertions."""
    here = list(front)
    for _ in STATES:
        for q in STATES:
            here[NEXT[q]] = min(here[NEXT[q]], here[q] + INSERT)
    costs = [FAR] * 4
    for q in STATES:
        for _, cost, to in arcs(symbol, q):
            costs[to] = min(costs[to], here[q] + cost, FAR)
    return *_least(costs), tuple(min(c, FAR) for c in here)


@cache
def steps(symbol: str | None, here: tuple[int, ...], ahead: tuple[int, ...], after: tuple[int, ...], total: int) -> dict[int, tuple[str, int]]:
    """For each state on a cheapest path: the edits up to and with the row, and the state behind it.

    ``here`` and ``ahead`` are the costs from the start and to go in front of the row, ``after`` those to go behind it,
    and an arc is tight if cost from the start, its own and cost to go make up ``total``. An inserted or re-roled row
    has its role's initial behind its letter.
    """
    tight = [q for q in STATES if here[q] + ahead[q] == total]
    out: dict[int, tuple[str, int]] = {}
    for begin in tight:
        frontier, edits = {begin}, ""
        while True:
            choices: dict[str, set[int]] = {}
            for q in frontier:
                if here[q] + INSERT + ahead[NEXT[q]] == total:
                    choices.setdefault("I", set()).add(NEXT[q])
                for letter, cost, to in arcs(symbol, q) if symbol else ():
                    if here[q] + cost + after[to] == total:
                        choices.setdefault(letter, set()).add(to)
            if not choices:
                break
            letter = min(choices)
            frontier = choices[letter]
            edits += letter + (INITIAL[min(frontier)] if letter in "IR" else "")
            if letter != "I":
                break
        out[begin] = (edits, min(frontier))
    return out


def matrix(symbols: str) -> list[int]:
    """Least costs through a piece from each state (row) to each state (column), flat."""
    out = []
    for q in STATES:
        costs, total = tuple(0 if p == q else FAR for p in STATES), 0
        for symbol in symbols:
            costs, low, _ = behind(symbol, costs)
            total += low
        out += [min(c + total, FAR) for c in costs]
    return out


def walks(symbols: str, front: tuple[int, ...], back: tuple[int, ...]) -> dict[int, tuple[str, int]]:
    """For each state that a cheapest path has in front of a piece: the edits, row by row and joined by commas, and the last state.

    ``front`` and ``back`` are the costs from the start in front of the piece and to go behind it.
    """
    forward, backward = [], [_least(list(back))]
    costs, low = _least(list(front))
    for symbol in symbols:
        after, more, here = behind(symbol, costs)
        forward.append((here, low))
        costs, low = after, low + more
    for symbol in reversed(symbols):
        costs, more = before(symbol, backward[-1][0])
        backward.append((costs, backward[-1][1] + more))
    backward.reverse()
    total = min(min(h + a, FAR) for h, a in zip(forward[0][0], backward[0][0], strict=True)) + forward[0][1] + backward[0][1]
    layers = []
    for i, symbol in enumerate(symbols):
        (here, far), (ahead, near), (after, left) = forward[i], backward[i], backward[i + 1]
        layers.append(steps(symbol, here, ahead, tuple(a + left - near for a in after), total - far - near))
    out = {}
    for begin in layers[0]:
        state, edits = begin, []
        for layer in layers:
            made, state = layer[state]
            edits.append(made)
        out[begin] = (",".join(edits), state)
    return out


def closing(state: int) -> str:
    """Insertions behind the last row."""
    costs, low = before(None, ENDS)
    return steps(None, costs_at(state), tuple(c + low for c in costs), ENDS, costs[state] + low)[state][0]


@cache
def costs_at(state: int) -> tuple[int, ...]:
    """Costs from one state on by insertions alone."""
    costs = [0 if q == state else FAR for q in STATES]
    for _ in STATES:
        for q in STATES:
            costs[NEXT[q]] = min(costs[NEXT[q]], costs[q] + INSERT)
    return tuple(costs)


def damaged(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) after damage by the CRC-32 of ``conv:turn`` modulo 20, with a space for each null.

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes
    it the user's. The conversation and the turn themselves stay null.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")), F.lit(MODULUS))
    plain = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"), kind.alias("_kind")).where("_kind <> 0")
    body = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    who = F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role"))
    twice = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return plain.select("conv", "turn", who.alias("role"), body.alias("text"), F.explode(twice).alias("_copy")).drop("_copy")


def ordered(turns: DataFrame) -> DataFrame:
    """``turns`` (conv, turn, role, text) sorted by ranges, with ``at``, which grows with the order and by one within a range.

    Conversations are in the order of their id and rows in that of their turn, nulls first, then of their role and of a
    hash of their text; rows alike in all that may stand in either order. Written, so that places don't change.
    """
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text")]
    return scratch.written(turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """(conv, turn, at, initial, fault) of ordered turns: the first of blank, duplicate and truncated that holds, or an empty string.

    The earliest row of each (conversation, role, text) comes from a partial minimum over digests, so no group of copies
    meets in one task; the minima are then joined to the rows by their unique place.
    """
    narrow = turns.select(
        "conv", "turn", "at", F.substring("role", 1, 1).alias("initial"), F.col("text").rlike(BLANK).alias("blank"), (~F.col("text").rlike(ENDING)).alias("open"),
        F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256).alias("said"),
    )
    firsts = narrow.groupBy("conv", "said").agg(F.min("at").alias("first")).select("first")
    met = narrow.join(firsts, F.col("at") == F.col("first"), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated").otherwise("")
    return met.select("conv", "turn", "at", "initial", fault.alias("fault"))


def _symbol() -> Column:
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    fault = F.when(F.col("fault").isin("blank", "duplicate"), "delete").otherwise(F.col("fault"))
    chosen = None
    for letter, (r, f) in SYMBOLS.items():
        held = (role == r) & (fault == f)
        chosen = F.when(held, letter) if chosen is None else chosen.when(held, letter)
    return chosen


def pieces(judged: DataFrame) -> DataFrame:
    """(conv, piece, at, symbols): the symbols of at most 2 ** ``PIECE_BITS`` neighbouring rows of a conversation, and the first row's place."""
    held = F.array_sort(F.collect_list(F.struct("at", "_symbol")))
    rows = judged.withColumn("_symbol", _symbol()).groupBy("conv", F.shiftright("at", PIECE_BITS).alias("piece")).agg(held.alias("_rows"))
    return rows.select("conv", "piece", F.col("_rows")[0]["at"].alias("at"), F.array_join(F.transform("_rows", lambda r: r["_symbol"]), "").alias("symbols"))


def _streamed(table: DataFrame, step, added: str, *, last_first: bool = False) -> DataFrame:
    """``table`` with the columns that ``step(same, row)`` gives for each row of a conversation in order; a task holds one row's state.

    ``step`` is made anew for each partition; ``same`` tells whether the row's conversation is that of the row before.
    """
    names = [c.split()[0] for c in added.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, known, conv = step(), False, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                out.append(take(known and row["conv"] == conv, row))
                known, conv = True, row["conv"]
            given = [pa.array(list(v), kind) for v, kind in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *given], names=[*batch.schema.names, *names])

    kinds = [{"string": pa.string(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}[c.split()[1]] for c in added.split(", ")]
    place = F.col("piece").desc() if last_first else F.col("piece")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields) + ", " + added
    return table.repartition("conv").sortWithinPartitions("conv", place).mapInArrow(run, schema)


def _through(costs: list[int], square: list[int]) -> list[int]:
    return [min(min(costs[q] + square[4 * q + p] for q in STATES), FAR) for p in STATES]


def _to_go(square: list[int], costs: list[int]) -> list[int]:
    return [min(min(square[4 * q + p] + costs[p] for p in STATES), FAR) for q in STATES]


def _back():
    """Costs to go behind a piece, from the conversation's last piece to its first."""
    ahead: list[int] = []

    def take(same: bool, row: dict) -> tuple:
        nonlocal ahead
        closed, low = before(None, ENDS)
        here = ahead if same else [c + low for c in closed]
        ahead = _to_go(row["square"], here)
        return (here, int(not same))

    return take


def _front():
    """Costs from the start in front of a piece, from the conversation's first piece to its last."""
    costs: list[int] = []

    def take(same: bool, row: dict) -> tuple:
        nonlocal costs
        here = costs if same else [0, FAR, FAR, FAR]
        costs = _through(here, row["square"])
        return (here,)

    return take


LEGAL = {"su", "ua", "au"}


def _chosen():
    """The edits of a piece from the state in which the piece before ended; cost on the first piece; illegal neighbours."""
    state, role = START, ""

    def take(same: bool, row: dict) -> tuple:
        nonlocal state, role
        if not same:
            state, role = START, ""
        begin = row["begins"].index(state)
        edits, state = row["edits"][begin], row["ends"][begin]
        if row["last"]:
            edits += "," + closing(state)
        roles = role + "".join(SYMBOLS[s][0] for s in row["symbols"])
        role = roles[-1]
        illegal = sum(roles[i : i + 2] not in LEGAL for i in range(len(roles) - 1))
        cost = min(f + g for f, g in zip(row["front"], _to_go(row["square"], row["back"]), strict=True)) if not same else 0
        return edits, cost, illegal

    return take


def _walked(table: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [walks(s, tuple(f), tuple(b)) for s, f, b in zip(*(batch.column(c).to_pylist() for c in ("symbols", "front", "back")), strict=True)]
            lists = [[list(w) for w in found], [[e for e, _ in w.values()] for w in found], [[e for _, e in w.values()] for w in found]]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, k) for x, k in zip(lists, kinds, strict=True))], names=[*batch.schema.names, "begins", "edits", "ends"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return table.mapInArrow(run, schema + ", begins array<bigint>, edits array<string>, ends array<bigint>")


def _squared(table: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            squares = [matrix(s) for s in batch.column(batch.schema.get_field_index("symbols")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(squares, pa.list_(pa.int64()))], names=[*batch.schema.names, "square"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return table.mapInArrow(run, schema + ", square array<bigint>")


def edits(judged: DataFrame) -> DataFrame:
    """(conv, piece, at, symbols, made, cost, illegal) of each piece: its edits, a comma behind every row's but the last.

    An edit is K, D, R or I; behind R and I stands the initial of the new role. The pieces of a conversation are shuffled
    three times, a few bytes for each row; a task holds the costs of one piece at a time.
    """
    squared = scratch.written(_squared(pieces(judged)), "pieces")
    back = _streamed(squared, _back, "back array<bigint>, last bigint", last_first=True)
    front = _streamed(back, _front, "front array<bigint>")
    chosen = _streamed(_walked(front), _chosen, "made string, cost bigint, illegal bigint")
    return chosen.select("conv", "piece", "at", "symbols", "made", "cost", "illegal")


def repaired(turns: DataFrame, made: DataFrame) -> DataFrame:
    """(conv, at, step, edit, role, text) of the repaired conversations: the rows of ordered ``turns`` after the edits of :func:`edits`.

    Inserted rows have an empty text and stand at the place of the row that follows, or of the last one, with steps that
    count up. Rows are joined to their edits by their unique place.
    """
    rowwise = made.select("at", "conv", F.size(F.split("made", ",")).alias("_n"), F.length("symbols").alias("_rows"), F.posexplode(F.split("made", ",")).alias("_i", "_made"))
    place = F.col("at") + F.least("_i", F.col("_rows") - 1)
    each = rowwise.select("conv", place.alias("at"), (F.col("_i") >= F.col("_rows")).alias("_after"), F.posexplode(F.regexp_extract_all("_made", F.lit("[A-Z][a-z]?"), 0)).alias("step", "edit"))
    new = F.when(F.col("edit").endswith("u"), "user").when(F.col("edit").endswith("a"), "assistant")
    placed = each.where("edit <> 'D'").withColumn("step", F.col("step") + F.when(F.col("_after"), 1 << 20).otherwise(0)).withColumn("_new", new)
    added = placed.where("edit like 'I%'").select("conv", "at", "step", F.lit("I").alias("edit"), F.col("_new").alias("role"), F.lit("").alias("text"))
    stay = placed.where("edit not like 'I%'").select(F.col("at").alias("_at"), "step", "edit", "_new")
    kept = turns.join(stay, F.col("at") == F.col("_at")).select("conv", "at", "step", F.substring("edit", 1, 1).alias("edit"), F.coalesce("_new", "role").alias("role"), "text")
    return kept.unionAll(added)


def digests(rows: DataFrame) -> DataFrame:
    """(conv, sha) of repaired rows: SHA-256 of ``role:text`` of all rows in order, joined by line ends.

    A digest takes its bytes one after another, so a conversation's rows pass through one task; they pass as a
    stream that Spark has sorted, and the task holds one batch of them.
    """
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for now, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if digest is None or now != conv:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = now, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            field = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], field), pa.array([d for _, d in done], pa.string())], names=["conv", "sha"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], field), pa.array([digest.hexdigest()])], names=["conv", "sha"])

    return rows.repartition("conv").sortWithinPartitions("conv", "at", "step").select("conv", "role", "text").mapInArrow(run, f"conv {kind}, sha string")


def repair_report(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation of ``rows``, damaged and then repaired: its faults, the cheapest edits and what they make.

    Columns: the conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Null roles and
    texts count as one space, null turns stand first and leave no gap, and a null conversation is one of its own. Rows of
    one turn are ordered by role and text hash, repeated rows by nothing, as they are alike. A conversation that loses
    all its rows has zeros, an empty audit and the digest of nothing. An empty table gives an empty result. Other columns
    are ignored, whatever their names.
    """
    turns = ordered(damaged(rows, conv=conv, turn=turn, role=role, text=text))
    judged = scratch.written(faults(turns), "judged-turns")
    by_turn = judged.groupBy("conv", "turn").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    counted = by_turn.groupBy("conv").agg(span.alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    made = scratch.written(edits(judged), "edits")
    letters = F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "made"))), lambda p: p["made"]), ""), "[a-z,]", "")
    mended = made.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), letters.alias("audit"))
    hashed = digests(repaired(turns, made))
    known = rows.select(F.col(conv).alias("conv")).distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    parts = known.unionByName(counted, allowMissingColumns=True).unionByName(mended, allowMissingColumns=True).unionByName(hashed, allowMissingColumns=True)
    whole = parts.groupBy("conv").agg(*[F.max(c).alias(c) for c in (*numbers, "audit", "sha")])
    return whole.select(
        F.col("conv").alias(conv), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(EMPTY_SHA)).alias("repaired_sha256"),
    )
