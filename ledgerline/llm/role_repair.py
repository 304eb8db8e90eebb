"""Repair of conversation structure by Four-Russians block tables.

Edits make the initials of a conversation's roles match (s?(ua)+)? at the least cost. `u`, `a` and the start need four states,
so what the rest of a conversation costs is a vector of four numbers. Less its minimum it is one of a few vectors, so a table has,
for each block of BLOCK symbols and each such vector after it, the vector before it and what was added. Conversations go
backwards through the table, a block a lookup; then forwards for the edits, where a block is expanded backwards into the
vectors within it and each step takes the ASCII-least letter that keeps the cost least.

Rows are dealt by ranges of (conversation, turn, role, text), so a conversation of any length lies in consecutive tasks. What a
task has of one is a piece (of PIECE rows at most). Conversations of one piece are done at once. For others a piece is a function
from the vector after it to the vector before it, and from the state before it to the state after it; only these small functions
are put together in order.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ship_code, staged

BLOCK, PIECE = 4, 4096
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1
#: Symbols: 2 * role + truncated for the roles s, u, a and any other; a row that must go; nothing (fills a block up).
GONE, NOTHING = 8, 9
_SYMBOLS = 10
#: States: nothing yet, after s, after u, after a. The state that an assistant's or user's row due next leads to.
DUE = (2, 2, 3, 2)
DUE_ROLE = ("user", "user", "assistant", "user")
_ACCEPT = (0, 3)
_NOT_BLANK, _ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def _kept(symbol: int, state: int) -> int | None:
    """The state after keeping a row, or None."""
    role = symbol // 2
    return {(0, 0): 1, (1, 0): 2, (1, 1): 2, (1, 3): 2, (2, 2): 3}.get((role, state)) if symbol < GONE else None


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs of the rest before a row, by state, from those after it."""
    if symbol == NOTHING:
        return after
    out = [DELETE + after[q] for q in range(4)]
    if symbol != GONE:
        extra = UNFINISHED * (symbol % 2)
        for q in range(4):
            out[q] = min(out[q], REROLE + extra + after[DUE[q]], *(KEEP + extra + after[k] for k in [_kept(symbol, q)] if k is not None))
    for _ in range(3):
        out = [min(out[q], INSERT + out[DUE[q]]) for q in range(4)]
    return tuple(out)


def _normal(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    low = min(costs)
    return tuple(c - low for c in costs), low


END = (0, 2 * INSERT, INSERT, 0)  # only inserts are left


@functools.cache
def tables() -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """(vectors, next, added): by block and vector after it, the vector before it and its minimum. END is vector 0.

    A block is its symbols as decimal digits, the first one foremost.
    """
    vectors, at = [END], {END: 0}
    one_next, one_added = [], []
    for v in vectors:  # grows while new ones come up
        row = [_normal(_before(s, v)) for s in range(_SYMBOLS)]
        for vector, _ in row:
            if vector not in at:
                at[vector] = len(vectors)
                vectors.append(vector)
        one_next.append([at[vector] for vector, _ in row])
        one_added.append([low for _, low in row])
    step, plus = np.array(one_next, np.int64).T, np.array(one_added, np.int64).T  # by symbol and vector
    into, added = step, plus
    for _ in range(BLOCK - 1):  # a symbol in front of all shorter blocks
        added = (added[None] + plus[:, into]).reshape(-1, len(vectors))
        into = step[:, into].reshape(-1, len(vectors))
    return vectors, into, added


def blocks(symbols: np.ndarray) -> np.ndarray:
    """Block codes of a run of symbols; the first block is filled up in front."""
    full = np.full(-(-len(symbols) // BLOCK) * BLOCK, NOTHING, np.int64)
    full[len(full) - len(symbols) :] = symbols
    return full.reshape(-1, BLOCK) @ 10 ** np.arange(BLOCK - 1, -1, -1)


def backwards(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vector before, cost added) of a run of blocks for each vector after it."""
    vectors, into, added = tables()
    now, cost = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
    for code in codes[::-1].tolist():
        cost += added[code, now]
        now = into[code, now]
    return now, cost


@functools.cache
def _expanded(code: int, vector: int, state: int) -> tuple[str, int]:
    """(edits, state after) of one block, by the costs within it."""
    symbols = [code // 10**k % 10 for k in range(BLOCK - 1, -1, -1)]
    costs = [tables()[0][vector]]
    for s in symbols[::-1]:
        costs.append(_before(s, costs[-1]))
    costs, out, q = costs[::-1], "", state
    for i, s in enumerate(symbols):
        while s != NOTHING:
            now, after, extra = costs[i][q], costs[i + 1], UNFINISHED * (s % 2)
            if now == DELETE + after[q]:
                out += "D"
                break
            if now == INSERT + costs[i][DUE[q]]:
                out, q = out + "I", DUE[q]
                continue
            kept = _kept(s, q)
            if kept is not None and now == KEEP + extra + after[kept]:
                out, q = out + "K", kept
            else:
                out, q = out + "R", DUE[q]
            break
    return out, q


def forwards(codes: np.ndarray, vector: int, state: int) -> tuple[str, int]:
    """(edits, state after) of a run of blocks that `vector` follows, from `state`."""
    after = [vector]
    into = tables()[1]
    for code in codes[:0:-1].tolist():
        after.append(int(into[code, after[-1]]))
    out = []
    for code, v in zip(codes.tolist(), after[::-1]):
        edits, state = _expanded(code, v, state)
        out.append(edits)
    return "".join(out), state


def closing(state: int) -> str:
    """Inserts at a conversation's end."""
    out = ""
    while state not in _ACCEPT:
        out, state = out + "I", DUE[state]
    return out


def messages_of(edits: str, state: int, symbols: bytes, rows: list[dict]) -> list[tuple[str, str]]:
    """(role, text) of what the edits leave; `rows` are those that needn't go, `symbols` all."""
    out, at, row = [], 0, 0
    for edit in edits:
        if edit == "I":
            out.append((DUE_ROLE[state], ""))
            state = DUE[state]
            continue
        symbol, own = symbols[at], None
        at += 1
        if symbol != GONE:
            own, row = rows[row], row + 1
        if edit == "K":
            out.append((own["role"], own["text"]))
            state = _kept(symbol, state)
        elif edit == "R":
            out.append((DUE_ROLE[state], own["text"]))
            state = DUE[state]
    return out


def damaged(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turn, role, text, copies) with a fifth of the rows damaged by crc32(`key:turn`) % 20, nulls of any column as a space
    there: 0 drops the row, 1 empties its text, 2 takes its [.!?] out, 3 repeats it, 4 makes its role user."""
    named = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(named(key), F.lit(":"), named("turn")).cast("binary")), F.lit(20))
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    return conversations.select(
        F.col(key).cast("long").alias(key), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"), kind.alias("kind"),
    ).where("kind <> 0").drop("kind")


def _judged(rows: DataFrame, most: int) -> DataFrame:
    """(conv_id, turn, role, text, part, copies, symbol, fault, initial): equal rows together, at most `most` of them in a row.

    `symbol` and `fault` (0 none, 1 blank, 2 duplicate, 3 truncated) are of a row's first copy; the others are blank if it is,
    else duplicates. `text` is null where no copy can stay. Role and text meet their first turn by a 256-bit digest.
    """
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    said = F.sha2(F.concat_ws("\x00", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role"), "role", "text"), 256)
    rows = rows.withColumn("said", F.unhex(said))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = rows.groupBy("said").agg(F.min(place).alias("first"))
    blank = ~F.col("text").rlike(_NOT_BLANK)
    parts = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / most).cast("int"))).alias("part")
    out = rows.join(firsts, "said").select("conv_id", "turn", "role", "text", "copies", (place > F.col("first")).alias("again"), blank.alias("blank"), parts)
    again = F.col("again") | (F.col("part") > 0)
    fault = F.when(F.col("blank"), 1).when(again, 2).when(~F.col("text").rlike(_ENDED), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    symbol = F.when(F.col("fault").isin(1, 2), GONE).otherwise(2 * role + (F.col("fault") == 3).cast("int"))
    out = out.withColumn("fault", fault).withColumn("symbol", symbol).withColumn("initial", initial)
    return out.withColumn("copies", F.least(F.lit(most), F.col("copies") - most * F.col("part")))


_PIECES = (
    "conv_id long, task int, nth long, whole boolean, symbols binary, rows array<struct<role:string,text:string>>, blank long, duplicate long, truncated long, illegal long, turns long, "
    "first_turn long, last_turn long, first_initial string, last_initial string, into array<int>, added array<long>"
)
_LEGAL = ("su", "ua", "au")


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the sorted rows of a task. A conversation is whole if neither the task's edge nor `most` rows cut it."""
    task, nth, cut = TaskContext.get().partitionId(), 0, object()
    held, first = None, True

    def made(rows: pa.Table, whole: list[tuple[int, int, bool]]) -> pa.RecordBatch:
        nonlocal nth
        copies = rows.column("copies").to_numpy()
        index = np.repeat(np.arange(len(rows)), copies)
        lead = np.append(True, np.diff(index) != 0) if len(index) else np.zeros(0, bool)
        fault, symbol = rows.column("fault").to_numpy()[index], rows.column("symbol").to_numpy()[index].copy()
        fault = np.where(lead, fault, np.where(fault == 1, 1, 2))
        symbol[~lead] = GONE
        initial = np.array(rows.column("initial").to_pylist(), object)[index]
        turn = rows.column("turn").fill_null(0).to_numpy()[index]
        known = rows.column("turn").is_valid().to_numpy()[index]
        roles, texts, ids = rows.column("role").to_pylist(), rows.column("text").to_pylist(), rows.column("conv_id")
        at = np.concatenate([[0], np.cumsum(copies)])
        out = []
        for a, b, complete in whole:
            lo, hi = at[a], at[b]
            for p in range(lo, hi, most):
                q = min(hi, p + most)
                initials, seen, symbols = initial[p:q], turn[p:q][known[p:q]].tolist(), symbol[p:q]
                into, added = backwards(blocks(symbols))
                if complete and hi - lo <= most:  # END follows
                    into, added = into[:1], added[:1]
                out.append({
                    "conv_id": ids[a].as_py(), "task": task, "nth": nth, "whole": complete and hi - lo <= most, "symbols": symbols.astype(np.uint8).tobytes(),
                    "rows": [{"role": roles[i], "text": texts[i]} for i in index[p:q][symbols != GONE].tolist()],
                    "blank": int((fault[p:q] == 1).sum()), "duplicate": int((fault[p:q] == 2).sum()), "truncated": int((fault[p:q] == 3).sum()),
                    "illegal": sum(x + y not in _LEGAL for x, y in zip(initials[:-1], initials[1:])), "turns": len(set(seen)),
                    "first_turn": seen[0] if seen else None, "last_turn": seen[-1] if seen else None,
                    "first_initial": initials[0], "last_initial": initials[-1], "into": into.tolist(), "added": added.tolist(),
                })
                nth += 1
        return pa.RecordBatch.from_pylist(out, _arrow_schema())

    def runs(rows: pa.Table) -> list[int]:
        ids, ok = rows.column("conv_id").fill_null(0).to_numpy(), rows.column("conv_id").is_valid().to_numpy()
        return [0, *(np.flatnonzero((np.diff(ids) != 0) | (ok[1:] != ok[:-1])) + 1).tolist(), len(rows)]

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        if not len(held):
            continue
        cuts = runs(held)
        last = cuts[-2]
        if len(held) - last > most:  # too long to wait for its end
            last = len(held)
        spans = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > last:
                break
            own = held.column("conv_id")[a].as_py()
            spans.append((a, b, not first and own != cut and b < len(held)))
            first, cut = False, own if b == len(held) else cut
        if spans:
            yield made(held.slice(0, last), spans)
            held = held.slice(last)
    if held is not None and len(held):
        yield made(held, [(0, len(held), False)])


@functools.cache
def _arrow_schema() -> pa.Schema:
    text, long = pa.string(), pa.int64()
    return pa.schema(
        [("conv_id", long), ("task", pa.int32()), ("nth", long), ("whole", pa.bool_()), ("symbols", pa.binary()), ("rows", pa.list_(pa.struct([("role", text), ("text", text)])))]
        + [(c, long) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn")]
        + [("first_initial", text), ("last_initial", text), ("into", pa.list_(pa.int32())), ("added", pa.list_(long))]
    )


def _blocks_of(symbols: bytes) -> np.ndarray:
    return blocks(np.frombuffer(symbols, np.uint8).astype(np.int64))


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces from the last to the first: the vector after each, and what it and all after it cost from the start state."""
    open_id, vector, cost = object(), 0, 0
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for conv, task, nth, into, added in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "task", "nth", "into", "added"))):
            if conv != open_id:
                open_id, vector, cost = conv, 0, 0
            after, cost, vector = vector, cost + added[vector], into[vector]
            for column, v in zip(out, (task, nth, after, cost + tables()[0][vector][0])):
                column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64())], ["task", "nth", "after", "cost"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[forwards(_blocks_of(s), v, q)[1] for q in range(4)] for s, v in zip(batch.column("symbols").to_pylist(), batch.column("after").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("task"), batch.column("nth"), pa.array(found, pa.list_(pa.int32()))], ["conv_id", "task", "nth", "exits"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_id, state = object(), 0
    for batch in batches:
        states = []
        for conv, exits in zip(batch.column("conv_id").to_pylist(), batch.column("exits").to_pylist()):
            open_id, state = conv, 0 if conv != open_id else state
            states.append(state)
            state = exits[state]
        yield pa.RecordBatch.from_arrays([batch.column("task"), batch.column("nth"), pa.array(states, pa.int32())], ["task", "nth", "entry"])


def _solved(pieces: DataFrame) -> DataFrame:
    """Pieces with the vector after them and the state before them; `cost`, of cut ones, is that of the piece and all after it."""
    whole = pieces.where("whole").withColumns({"after": F.lit(0), "entry": F.lit(0), "cost": F.lit(None).cast("long")})
    cut = pieces.where("not whole")
    in_order = lambda df, *order: df.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    follow = in_order(cut.select("conv_id", "task", "nth", "into", "added"), F.desc("task"), F.desc("nth")).mapInArrow(_followed, "task int, nth long, after int, cost long")
    cut = staged(cut.join(follow, ["task", "nth"]), "cut-pieces")
    exits = cut.select("conv_id", "task", "nth", "symbols", "after").mapInArrow(_exits, "conv_id long, task int, nth long, exits array<int>")
    entries = in_order(exits, "task", "nth").mapInArrow(_entries, "task int, nth long, entry int")
    return whole.unionByName(cut.join(entries, ["task", "nth"]).select(whole.columns))


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Report:
    """One conversation's report, fed with its pieces in order."""

    def __init__(self, conv: int | None):
        self.conv, self.counts, self.turns, self.least, self.greatest = conv, [0, 0, 0, 0], 0, None, None
        self.initial, self.cost, self.audit, self.state, self.hash, self.any = None, 0, [], 0, hashlib.sha256(), False

    def add(self, p: dict) -> None:
        codes = _blocks_of(p["symbols"])
        edits, state = forwards(codes, p["after"], self.state)
        if self.initial is None:
            self.cost = p["cost"] if p["cost"] is not None else p["added"][0] + tables()[0][p["into"][0]][0]
        else:
            self.counts[3] += self.initial + p["first_initial"] not in _LEGAL
        self._hash(messages_of(edits, self.state, p["symbols"], p["rows"]))
        self.counts = [x + p[c] for x, c in zip(self.counts, ("blank", "duplicate", "truncated", "illegal"))]
        if p["first_turn"] is not None:
            self.turns += p["turns"] - (self.greatest == p["first_turn"])
            self.least, self.greatest = p["first_turn"] if self.least is None else self.least, p["last_turn"]
        self.initial, self.state = p["last_initial"], state
        self.audit.append(edits)

    def _hash(self, messages: list[tuple[str, str]]) -> None:
        if messages:
            self.hash.update(("\n" * self.any + "\n".join(f"{role}:{text}" for role, text in messages)).encode())
            self.any = True

    def row(self) -> tuple:
        tail, state, left = closing(self.state), self.state, []
        for _ in tail:
            left.append((DUE_ROLE[state], ""))
            state = DUE[state]
        self._hash(left)
        gaps = self.greatest - self.least + 1 - self.turns if self.least is not None else 0
        return (self.conv, gaps, *self.counts, self.cost, "".join(self.audit) + tail, self.hash.hexdigest())


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of conversations whose pieces come one after another, in order; a batch of pieces is held at a time."""
    names, now = [f.split()[0] for f in _REPORT.split(", ")], None
    types = [pa.int64()] * 7 + [pa.string()] * 2
    for batch in batches:
        out = []
        for p in batch.to_pylist():
            if now is None or now.conv != p["conv_id"]:
                if now is not None:
                    out.append(now.row())
                now = _Report(p["conv_id"])
            now.add(p)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(now.row(), types)], names)


def pieces(rows: DataFrame, key: str = "conv_id", most: int = PIECE) -> DataFrame:
    """Solved pieces, of `most` rows at most, of rows (key, turn, role, text, copies), for `report` and `repaired`; written to the shared folder."""
    ship_code(rows.sparkSession)
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = rows.select(F.col(key).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), copies.cast("long").alias("copies"))
    order = ["conv_id", "turn", "role", "text", "part"]
    dealt = _judged(given, most).repartitionByRange(*(F.col(c).asc_nulls_first() for c in order)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in order))
    dealt = dealt.select("conv_id", "turn", "role", F.when(F.col("symbol") != GONE, F.col("text")).alias("text"), "copies", "symbol", "fault", "initial")
    return staged(_solved(staged(dealt.mapInArrow(lambda batches: _pieces(batches, most), _PIECES), "pieces")), "solved")


def report(solved: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row a conversation."""
    cut = solved.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "task", "nth")
    return solved.where("whole").mapInArrow(_reports, _REPORT).unionByName(cut.mapInArrow(_reports, _REPORT)).withColumnRenamed("conv_id", key)


def repaired(solved: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, task, nth, place, role, text): the repaired conversations' messages, in the order of task, nth and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                edits, state = forwards(_blocks_of(p["symbols"]), p["after"], p["entry"])
                found = messages_of(edits, p["entry"], p["symbols"], p["rows"])
                if p["last"]:
                    for _ in closing(state):
                        found.append((DUE_ROLE[state], ""))
                        state = DUE[state]
                out += [(p["conv_id"], p["task"], p["nth"], i, role, text) for i, (role, text) in enumerate(found)]
            if out:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["conv_id", "task", "nth", "place", "role", "text"])

    ends = solved.where("not whole").groupBy("conv_id").agg(F.max(F.struct("task", "nth")).alias("end")).select("end.task", "end.nth", F.lit(True).alias("last"))
    marked = solved.join(ends, ["task", "nth"], "left").withColumn("last", F.coalesce("last", "whole"))
    return marked.mapInArrow(run, "conv_id long, task int, nth long, place int, role string, text string").withColumnRenamed("conv_id", key)


def repair(conversations: DataFrame, rows: DataFrame | None = None, key: str = "conv_id") -> DataFrame:
    """The report for each key of `conversations` over `rows` (as `damaged` gives them; by default the conversations themselves).

    Nulls in role and text are a space; a null key is a conversation of its own, null turns come first. Rows of one turn go by
    role and text, as bytes, so equal rows are neighbours. A role without a character can't be kept. A key without rows has
    zeros, an empty audit and the hash of an empty text. Other columns are ignored; an empty table gives an empty one.
    """
    rows = conversations if rows is None else rows
    found = report(pieces(rows, key), key)
    keys = conversations.select(F.col(key).cast("long").alias("own")).distinct()
    out = keys.join(found, F.col("own").eqNullSafe(F.col(key)), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("own").alias(key), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
