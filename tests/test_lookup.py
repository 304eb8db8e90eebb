"""Substring lookups against comparing all with all."""

import random
import time

from ledgerline.operators import graph as G
from ledgerline.operators.lookup import held_in


def test_pairs_of_texts_that_hold_each_other(spark):
    rng = random.Random(1)
    word = lambda a, b: "".join(rng.choice("abé ") for _ in range(rng.randrange(a, b)))
    needles, hays = [word(0, 9) for _ in range(150)] + [None, "", "abab", "abab"], [word(0, 40) for _ in range(200)] + [None, "", "xababx"]
    one = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    want = {(n, h) for n in needles if n is not None for h in hays if h is not None and n in h}
    for gram in (1, 3, 4):
        got = [tuple(r) for r in held_in(one("needle", needles), one("hay", hays), gram).collect()]
        assert set(got) == want and len(got) == len(want)
    assert held_in(one("needle", []), one("hay", hays)).count() == held_in(one("needle", needles), one("hay", [])).count() == 0


def rule(q, companies):
    u, low = q.strip(" ").upper(), q.strip(" ").lower()
    tests = [lambda c: c[1] is not None and c[1].upper() == u, lambda c: f"comp_{c[0]}" == q, lambda c: f"comp_{c[0]}" == f"comp_{q}", lambda c: (c[2] or "\0").lower() == low, lambda c: c[2] is not None and (low in c[2].lower() or c[2].lower() in low)]
    for test in tests:
        if found := [c[0] for c in companies if test(c)]:
            return min(found)
    return None


COMPANIES = [(i, f"T{i}", f"{'Acme' if i % 3 else 'Zeta'} Works {i:04d}") for i in range(400)] + [(500, None, "é"), (501, "X", None), (502, "LONG", "a very long name of a company")]


def test_companies_by_any_rule_for_many_questions(spark):
    asked = ["t7", "comp_9", "31", "acme works 0005", "0007", "works", "about a very long name of a company ltd", "é", "caféx", "zzz", " ", "", "ZETA", "9 "]
    c = spark.createDataFrame(COMPANIES, "id long, ticker string, name string")
    got = {r.q: r.id for r in G.find_companies(spark.createDataFrame([(q,) for q in [*asked, *asked, None]], "q string"), c).collect()}
    assert got == {q: rule(q, COMPANIES) for q in asked if rule(q, COMPANIES) is not None}
    many = [(f"{k} of works {k % 600:04d}?",) for k in range(100_000)]
    began = time.time()
    assert G.find_companies(spark.createDataFrame(many, "q string"), c).count() == 0
    some = [(f"works {k % 600:04d}" if k % 2 else f"{k} on Zeta Works {k % 600:04d} et al.",) for k in range(100_000)]
    found = {r.q: r.id for r in G.find_companies(spark.createDataFrame(some, "q string"), c).collect()}
    assert time.time() - began < 120
    assert all(found.get(q) == rule(q, COMPANIES) for q, in some[:600]) and len(found) > 10_000


def test_targets_of_many_questions(spark):
    c = spark.createDataFrame(COMPANIES, "id long, ticker string, name string")
    texts = ["What of T12 and t399?", "zeta margins", "Nothing here", None, "0007?", "long a company of name", "Tell me"]
    questions = [(i, texts[i % len(texts)], [None, 5, 999][i % 3]) for i in range(42)]

    def want(text, given):
        if given in {c[0] for c in COMPANIES}:
            return {given}
        low = (text or "").lower()
        named = {i for i, t, n in COMPANIES if text is not None and (t is not None and t.lower() in low or any(len(w) > 3 and w in low for w in (n or "").lower().split()))}
        return named or {c[0] for c in COMPANIES}

    got: dict = {}
    rows = G.resolve_targets(spark.createDataFrame(questions, "qid int, question string, company_id long"), c).collect()
    for r in rows:
        got.setdefault(r.qid, set()).add(r.company_id)
    assert got == {q: want(t, g) for q, t, g in questions} and len(rows) == sum(map(len, got.values()))
