"""Conversation repair against an exhaustive search and the query's SQL."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from ledgerline.llm import role_repair as R
from ledgerline.llm.queries import ORACLES, QUERIES

from ..oracle import check

SCHEMA = "conv_id long, turn long, role string, text string, copies int"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(key.encode()) % 20
        row = (conv, turn, "user" if kind == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text))
        out += [] if kind == 0 else [row] * (2 if kind == 3 else 1)
    return out


def search(rows):
    """(cost, edits, lines): the least of all edit strings by (cost, letters), forwards over (state, strings), without tables."""
    best, seen = {0: (0, "", ())}, set()
    nxt, due = {0: 2, 1: 2, 2: 3, 3: 2}, {0: "user", 1: "user", 2: "assistant", 3: "user"}

    def inserts(b):
        for _ in range(3):
            for q, (c, a, t) in list(b.items()):
                new = (c + 2, a + "I", (*t, f"{due[q]}:"))
                if nxt[q] not in b or new < b[nxt[q]]:
                    b[nxt[q]] = new
        return b

    for role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        must = blank or (role, text) in seen
        seen.add((role, text))
        extra = not must and not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
        out = {}
        for q, (c, a, t) in inserts(dict(best)).items():
            moves = [(q, (c + 3, a + "D", t))]
            if not must:
                moves.append((nxt[q], (c + 2 + extra, a + "R", (*t, f"{due[q]}:{text}"))))
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((q, role[:1]))
                if to is not None:
                    moves.append((to, (c + extra, a + "K", (*t, f"{role}:{text}"))))
            for to, new in moves:
                if to not in out or new < out[to]:
                    out[to] = new
        best = out
    return min(v for q, v in inserts(dict(best)).items() if q in (0, 3))


def plain(rows):
    """Reports by conversation of damaged rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        counts, seen = [0, 0, 0], set()
        for _, _, role, text in own:
            faults = [not re.search(r"[^\x20\x09-\x0D]", text), (role, text) in seen, not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)]
            seen.add((role, text))
            if any(faults):
                counts[faults.index(True)] += 1
        turns = [r[1] for r in own if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = search([r[2:] for r in own])
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def given(rng, convs, most):
    texts = ["Good.", "so so", "", " \t", "What?", "é!", "line\nline", "end. \n", "No!  ", "..", "a", "b.", "c?", "d", "e."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "User", "s", None]
    return [
        (conv if conv else None, rng.choice([None, *range(most)]), rng.choice(roles), rng.choice([*texts, None, f"{rng.random()}."]))
        for conv in range(convs) for _ in range(rng.randrange(1, most))
    ]


def reports(found, key="conv_id"):
    return {r[key]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in found.collect()}


def test_tables_are_what_single_steps_give():
    vectors, into, added = R.tables()
    assert vectors[0] == R.END and 4 < len(vectors) < 200 and into.shape == (10**R.BLOCK, len(vectors))
    rng = random.Random(3)
    for _ in range(500):
        symbols, v = [rng.randrange(10) for _ in range(R.BLOCK)], rng.randrange(len(vectors))
        costs = vectors[v]
        for s in symbols[::-1]:
            costs = R._before(s, costs)
        code = int("".join(map(str, symbols)))
        assert tuple(c + added[code, v] for c in vectors[into[code, v]]) == costs


def test_edits_are_the_least_of_all():
    rng = random.Random(4)
    names = {0: "system", 1: "user", 2: "assistant", 3: "x"}
    every = [list(p) for n in range(4) for p in itertools.product(range(9), repeat=n)] + [[rng.randrange(9) for _ in range(rng.randrange(4, 40))] for _ in range(300)]
    for symbols in every:
        rows = [("x", "") if s == R.GONE else (names[s // 2], f"{i}" + "." * (s % 2 == 0)) for i, s in enumerate(symbols)]
        codes = R.blocks(np.array(symbols, np.int64))
        into, plus = R.backwards(codes)
        edits, state = R.forwards(codes, 0, 0)
        cost, audit, _ = search(rows)
        assert (plus[0] + R.tables()[0][into[0]][0], edits + R.closing(state)) == (cost, audit)


def test_reports_equal_plain_ones_whole_and_cut(spark):
    rng = random.Random(7)
    rows = given(rng, 60, 14) + [(99, i % 700, ["user", "assistant"][i % 2], f"{i % 500}{'.' * (i % 7 > 0)}") for i in range(1500)]
    rows += [(98, 5, "user", "again and again.")] * 600  # one row's copies, over several pieces
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv in {r[0] for r in rows}} | plain(damage(rows))
    assert reports(R.repair(frame, R.damaged(frame))) == want
    solved = R.pieces(R.damaged(frame), most=16)
    assert solved.where("not whole").count() > 100
    assert reports(R.report(solved)) == plain(damage(rows))
    found = sorted(R.repaired(solved).collect(), key=lambda r: (str(r.conv_id), r.task, r.nth, r.place))
    for conv in (7, 98, 99):
        lines = [f"{r.role}:{r.text}" for r in found if r.conv_id == conv]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == plain(damage(rows))[conv][-1]


def test_repair_of_other_tables(spark):
    assert R.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    undamaged = spark.createDataFrame([(1, 0, "assistant", "Hi.", 9), (1, 1, "user", "x" * 3_000_000 + ".", 9)], "conv_id int, turn int, role string, text string, cost int")
    row = R.repair(undamaged).first()
    assert (row.audit, row.cost, row.illegal) == ("IKKI", 4, 0)


def test_query_equals_its_sql(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        check(QUERIES["op13_role_repair"](spark, folder), ORACLES["op13_role_repair"], folder)


@pytest.mark.parametrize("case", [[(None, None, None, None)], [(1, 2, "user", "a")] * 3, [(5, None, "", "x."), (5, None, "user", "y.")]])
def test_sql_treats_edges_alike(spark, case):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(case, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64", "role": "string", "text": "string"}))
    frame = spark.createDataFrame(case, "conv_id long, turn long, role string, text string")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = con.execute(f"select {', '.join(names)} from ({ORACLES['op13_role_repair']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in names)) for r in R.repair(frame, R.damaged(frame)).collect())
