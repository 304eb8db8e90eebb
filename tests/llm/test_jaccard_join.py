"""The Jaccard join against all pairs, and its query against SQL."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import jaccard_join as J
from ledgerline.llm import set_pairs
from ledgerline.llm.queries import ORACLES, QUERIES

from ..oracle import check
from .test_dedup import SCHEMA, TWIN, corpus, shingles, words


def brute(texts, percent=80):
    """({doc_id: (n_shingles, component_id)}, links between different sets by their least ids)."""
    sets = {i: frozenset(shingles(t)) for i, t in texts.items()}
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i], i)
    root, links = {i: (least[s] if s else i) for i, s in sets.items()}, set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, i), (b, j) in itertools.combinations([(s, i) for s, i in least.items() if s], 2):
        if 100 * len(a & b) >= percent * len(a | b):
            links.add((max(i, j), min(i, j)))
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}, links


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in texts.items()], SCHEMA).repartition(4)


def shared_lines(n=120):
    """Texts put together from a few common lines, so that rare shingles are few, and near copies of near copies."""
    rng = random.Random(11)
    lines = [" ".join(words(rng, 18)) for _ in range(9)]
    texts = {i: " ".join(rng.sample(lines, rng.randrange(2, 7)) + words(rng, rng.randrange(6))) for i in range(n)}
    chain = words(rng, 70)
    for i in range(n, n + 25):  # neighbours are alike, ends aren't
        chain[rng.randrange(70)] = f"new{i}"
        texts[i] = " ".join(chain)
    return texts


@pytest.mark.parametrize("texts", [corpus(), shared_lines()], ids=["corpus", "lines"])
def test_components_and_links_equal_all_pairs(spark, texts):
    for percent in (80, 60):
        want, links = brute(texts, percent)
        got = J.jaccard_components(frame(spark, texts), percent=percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert sorted((r.u, r.v) for r in J.jaccard_links(frame(spark, texts), percent=percent).collect()) == sorted(links)


def test_a_common_shingle_of_many_small_components(spark):
    rng = random.Random(12)
    line = " ".join(words(rng, 12))
    texts = {i: f"{line} {' '.join(words(rng, 3))}" for i in range(400)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(frame(spark, texts)).collect()} == brute(texts)[0]


def test_nulls_repeats_weak_hashes_and_nothing(spark):
    rows = [(None, "one two three four five six", "", 0), (7, "one two three four five six", "", 0), (7, "one two three four five six", "", 0), (9, "One two three four five six", "", 0)]
    rows += [(3, None, "", 0), (4, " \n", "", 0), (5, "a b c d", "", 0), (6, "A B c d", "", 0), (8, "a b c d e", "", 0)]
    got = J.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.n_shingles) for r in got) == [("3", "3", 0), ("4", "4", 0), ("5", "5", 1), ("6", "5", 1), ("7", "7", 2), ("7", "7", 2), ("8", "8", 1), ("9", "7", 2), ("None", "None", 2)]
    assert J.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    other, rest = TWIN.translate(str.maketrans("ab", "ba")), "one two three four five six seven"
    got = J.jaccard_components(frame(spark, {1: f"{TWIN} {rest}", 2: f"{other} {rest}", 3: f"x {TWIN} y {other} z"})).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3}


def test_pairs_of_a_hub_are_checked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(set_pairs, "BLOCK", 7)
    sets = {0: list(range(0, 100)), **{i: list(range(i % 40, 100 + i % 3)) for i in range(1, 60)}, 99: [500]}
    pairs = [(i, 0) for i in range(1, 60)] + [(0, 99), (1, 2), (5, 98), (3, 3)]
    got = set_pairs.linked(spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame(list(sets.items()), "id long, s array<long>"), 80)
    want = {(max(u, v), min(u, v)) for u, v in pairs if u in sets and v in sets and 100 * len({*sets[u]} & {*sets[v]}) >= 80 * len({*sets[u]} | {*sets[v]}) if u != v}
    assert {(r.u, r.v) for r in got.where(F.col("u") != F.col("v")).collect()} == want


def test_query_equals_its_sql(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        check(QUERIES["op11_jaccard_join"](spark, folder), ORACLES["op11_jaccard_join"], folder)
