"""Near-dedup, line dedup and components against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm.components import components
from ledgerline.llm.line_dedup import dedup_lines
from ledgerline.llm.near_dedup import near_duplicates, superminhash

from ..oracle import check

SCHEMA = "doc_id long, text string, component_id string, kept int"


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau".split()) + str(rng.randrange(40)) for _ in range(n)]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus():
    rng = random.Random(5)
    texts = {}
    for g in range(6):
        base = words(rng, 60 + 40 * g)
        for k in range(14):
            w = list(base)
            for _ in range(rng.randrange(7)):
                w[rng.randrange(len(w))] = rng.choice(["x", "y", "z"]) + str(rng.randrange(99))
            texts[g * 20 + k] = " ".join(w)
    texts |= {200: "", 201: " \n ", 202: "Hello World", 203: "hello world", 204: "hello", 205: texts[3], 206: "a b c d e", 207: None}
    return texts


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus()
    rows = [(i, t, "clash", 1) for i, t in texts.items()]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_nulls_repeats_and_nothing(spark):
    rows = [(None, "one two three four five six", "", 0), (7, "one two three four five six", "", 0), (7, "one two three four five six", "", 0), (9, "One two three four five six", "", 0)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("7", "7", True), ("7", "7", True), ("9", "7", False), ("None", "None", True)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_that_share_an_id_keep_their_links(spark):
    rng = random.Random(6)
    one, two = (" ".join(words(rng, 40)) for _ in range(2))
    rows = [(7, one, "", 0), (7, two, "", 0), (9, two + " more", "", 0), (11, one + " more", "", 0), (12, "nothing like it at all", "", 0)]
    for order in (rows, rows[::-1]):
        got = near_duplicates(spark.createDataFrame(order, SCHEMA)).collect()
        assert {r.doc_id: r.component_id for r in got} == {7: 7, 9: 7, 11: 7, 12: 12}


TWIN = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))  # words that polynomial hashes modulo 2^64 can't tell apart


def test_words_that_weak_hashes_confuse(spark):
    other = TWIN.translate(str.maketrans("ab", "ba"))
    rest = "one two three four five six seven"
    got = near_duplicates(spark.createDataFrame([(1, f"{TWIN} {rest}", "", 0), (2, f"{other} {rest}", "", 0), (3, f"x {TWIN} y {other} z", "", 0)], SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3}
    texts = {1: f"{TWIN} " * 30 + rest * 9, 2: f"{TWIN} " * 30 + f"{other} " * 30}
    assert left_by_code(spark, texts) == left_by_rule(texts)


def test_superminhash_is_a_permutation_sketch():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [a[:2000], a[500:2500], a[:1], a[:3]]
    sig = superminhash(sets, 256)
    assert abs((sig[0] == sig[1]).mean() - 1500 / 2500) < 0.1
    assert sorted(np.floor(sig[2]).astype(int)) == list(range(256))  # one element fills one slot a level
    assert (superminhash(sets[1:], 256) == sig[1:]).all()


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(5, 5), (300, 200), (200, 300)]
    random.Random(2).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 120)}, 300: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_dedup_sql(spark):
    from ledgerline.llm.queries import ORACLES, QUERIES

    folder = "/root/testdata/sf0.001"
    check(QUERIES["op1_near_dedup"](spark, folder), ORACLES["op1_near_dedup"], folder)


def runs(text, n):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_repeated_passages_go_from_later_documents(spark):
    rng = random.Random(3)
    passage = " ".join(words(rng, 9)) + ". " + " ".join(words(rng, 30)) + "! " + " ".join(words(rng, 25)) + "."
    short = " ".join(words(rng, 20)) + "."
    texts = {i: " ".join(words(rng, 70)) + ".\n" + short + "\n" + " ".join(words(rng, 15)) for i in range(12)}
    for i in (2, 5, 7, 11):
        texts[i] = texts[i].replace("\n", f" and {passage} then ", 1)
    texts[9] = passage + "\n" + passage + "\n" + texts[9]
    texts |= {20: texts[5], 21: None, 22: "", 23: "no stops " * 40}
    rows = [(i, t, "x", 3) for i, t in texts.items()] + [(None, texts[5], "x", 3)]
    got = dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    left = {r.doc_id: r for r in got}
    seen = set()
    for i in sorted(texts):
        assert not runs(left[i].text, 51) & seen or i == 23
        seen |= runs(left[i].text, 51)
    assert passage in left[2].text and left[20].text == "" and left[21].text is None and left[22].text == ""
    assert left[None].text == texts[5]
    for i in (0, 1, 3, 4, 6, 8, 10, 23):
        assert left[i].text == texts[i] and left[i].removed_words == 0
    assert short in left[9].text  # in 5, 7 and 11 it lies in the block that repeats
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_that_share_an_id_are_cut_each_by_itself(spark):
    rng = random.Random(16)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(4, a, "", 0), (4, b, "", 0), (4, a, "", 0), (6, f"x {b} y", "", 0), (8, f"{c} {a}", "", 0)]
    for order in (rows, rows[::-1]):
        got = dedup_lines(spark.createDataFrame(order, SCHEMA)).collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted([(4, a), (4, b), (4, a), (6, "x y"), (8, c)])


@pytest.mark.parametrize("n", [1, 3])
def test_repeated_rows_do_not_count_against_each_other(spark, n):
    text = "One line of words that goes on. " * 20
    got = dedup_lines(spark.createDataFrame([(4, text, "", 0)] * n, SCHEMA)).agg(F.count("*"), F.sum("removed_words")).first()
    assert tuple(got) == (n, 0)


def left_by_rule(texts, least=50):
    """What stays if every word in a run of `least` words that an earlier document has goes."""
    seen, out = set(), {}
    for i in sorted(texts):
        w = texts[i].split()
        gone = {q for p in range(len(w) - least + 1) if tuple(w[p : p + least]) in seen for q in range(p, p + least)}
        out[i] = [x for q, x in enumerate(w) if q not in gone]
        seen |= runs(texts[i], least)
    return out


def left_by_code(spark, texts):
    return {r.doc_id: r.text.split() for r in dedup_lines(spark.createDataFrame([(i, t, "", 0) for i, t in texts.items()], SCHEMA)).collect()}


def test_every_run_of_fifty_words_has_an_anchor(spark):
    rng = random.Random(12)
    texts = {1: "and " * 60, 2: "before " + "and " * 55 + "after"}
    for k in range(60):
        passage = " ".join(words(rng, 50 + k % 3))
        for j in range(2):
            texts[10 + 2 * k + j] = " ".join([*words(rng, 20 + rng.randrange(30)), passage, *words(rng, 20 + rng.randrange(30))])
    assert left_by_code(spark, texts) == left_by_rule(texts)


def test_each_run_finds_an_earlier_document_that_has_all_of_it(spark):
    """Document 1 has the lines of the passage of 2 and 3 too, but never 50 words of it in a row."""
    rng = random.Random(13)
    lines = [" ".join(words(rng, 14)) + "." for _ in range(12)]
    own = lambda n: " ".join(words(rng, n)) + "."
    broken = [x for k, line in enumerate(lines) for x in ([line, own(9)] if k % 3 == 2 else [line])]
    texts = {1: "\n".join(broken), 2: "\n".join([own(30), *lines]), 3: "\n".join([own(20), *lines, own(20)]), 4: "\n".join(rng.sample(lines, 12))}
    assert left_by_code(spark, texts) == left_by_rule(texts)
    assert len(left_by_rule(texts)[3]) == 40


def test_places_after_the_first_count(spark):
    """The earlier document has A B and C D apart, and later all four together."""
    rng = random.Random(14)
    a, b, c, d = (" ".join(words(rng, 16)) + "." for _ in range(4))
    own = lambda: " ".join(words(rng, 15)) + "."
    texts = {1: "\n".join([own(), a, b, own(), c, d, own(), a, b, c, d, own()]), 2: "\n".join([own(), a, b, c, d, own()])}
    assert left_by_code(spark, texts) == left_by_rule(texts)
    assert len(left_by_rule(texts)[2]) == 30
