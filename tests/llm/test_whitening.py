"""Whitening against whole-number sums by hand and numpy's double arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from ledgerline.llm import whitening as W
from ledgerline.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, n int, component string"


def exact(vectors, scale=256):
    """(x of usable rows, n, sums, covariance as fractions) over distinct vectors."""
    rows = [(i, [math.floor(scale * c) for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max(len(x) for _, x in rows)
    rows = [(i, x + [0] * (dims - len(x))) for i, x in rows]
    once = sorted({tuple(x) for _, x in rows})
    n = len(once)
    sums = [sum(x[d] for x in once) for d in range(dims)]
    cov = [[Fraction(n * sum(x[i] * x[j] for x in once) - sums[i] * sums[j], n * n) for j in range(dims)] for i in range(dims)]
    return rows, n, sums, cov


def held(spark, vectors, **options):
    rows, n, sums, cov = exact(vectors)
    got = W.whiten(spark.createDataFrame([(i, v and [c if c is None else float(c) for c in v], 1, "x") for i, v in vectors], SCHEMA).repartition(3), **options).collect()
    dims = len(sums)
    k = min(4, dims)
    values, vecs = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    trace = float(sum(cov[d][d] for d in range(dims)))
    assert len(got) == len(rows) * k and {r.n for r in got} == {n}
    deviation = {(i, tuple(x)): sum((n * c - s) ** 2 for c, s in zip(x, sums)) for i, x in rows}
    assert sorted(str(r.deviation) for r in got) == sorted(str(v if v < 2**63 else None) for v in [deviation[i, tuple(x)] for i, x in rows] for _ in range(k))
    for c in range(k):
        own = [r for r in got if r.component == c + 1]
        want = {i: float((np.array([float(Fraction(n * v - s, n)) for v, s in zip(x, sums)]) @ vecs[:, c]) / np.sqrt(values[c])) for i, x in rows}
        sign = np.sign(sum(r.whitened * want[r.vec_id] for r in own))
        assert all(abs(sign * r.whitened - want[r.vec_id]) < 1e-6 for r in own)
        assert all(abs(r.explained - values[c] / trace) <= 1e-9 for r in own)
    assert {r.identity_error for r in got} and all(r.identity_error < 1e-8 for r in got)
    return got


def test_whitening_equals_exact_arithmetic(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 6)) @ np.diag([3, 2, 1.5, 1, 0.5, 0.1]) @ rng.normal(size=(6, 6)) + 4
    vectors = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(200)]
    vectors += [(2000, None), (2001, [1.0, None, 0, 0, 0, 0]), (2002, [math.nan] * 6), (2003, [math.inf, 0, 0, 0, 0, 0]), (2004, [-0.0, 0, 0, 0, 0, 0]), (2005, [0.0, -0.0, 0, 0, 0, 0])]
    held(spark, vectors)


def test_wide_entries_and_short_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(v) * 2.0**40, float(w) * 2.0**41, (5.0 + i % 3) * 2.0**40]) for i, (v, w) in enumerate(rng.normal(size=(90, 2)))] + [(100, [1.5]), (101, [1.5, 0.0]), (102, [])]
    held(spark, vectors)


def test_no_variance_and_nothing(spark):
    same = W.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, ""), (1, [1.0, 2.0], 1, ""), (None, [1.0, 2.0], 1, "")], SCHEMA)).collect()
    assert len(same) == 6 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in same)
    line = W.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], 1, "") for i in range(5)], SCHEMA)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and all(r.identity_error < 1e-12 for r in line)
    for rows in ([], [(1, None, 1, "")], [(1, [], 1, "")]):
        assert W.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


@pytest.mark.parametrize("high", [2, 2**9, 2**31, 2**62])
def test_scatter_is_exact(high):
    rng = np.random.default_rng(high % 97)
    for n in (1, 63, 64, 65, 700):
        x = rng.integers(-high, high, (n, 5))
        one = [[int(v) for v in r] + [1] for r in x]
        got = W.scatter(np.ascontiguousarray(x))
        assert all(got[i, j] == sum(r[i] * r[j] for r in one) for i in range(6) for j in range(i, 6))


def test_query_over_the_given_vectors(spark):
    folder = "/root/testdata/sf0.001"
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    rows, n, sums, _ = exact(given)
    got = QUERIES["op12_whitening"](spark, folder).collect()
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    by_id = dict(rows)
    assert all(r.deviation == sum((n * c - s) ** 2 for c, s in zip(by_id[r.vec_id], sums)) for r in got)
    white = np.zeros((len(rows), 4))
    for r in got:
        white[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(white.T @ white / n - np.eye(4)).max() < 1e-9 and all(r.identity_error < 1e-9 for r in got)
