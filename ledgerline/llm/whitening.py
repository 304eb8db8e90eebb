"""Whitening of embeddings by a bit-sliced scatter matrix.

Vectors become whole numbers, floor(scale * c). Of the distinct ones, each task shifts each dimension of a block of rows by its
least value, packs each bit of it across the rows into words, and adds up popcounts of the ANDs of two planes, weighted by the
planes' powers of two: exact sums of products, the shift taken out again in whole numbers. A last column of ones gives the sums
and the number of rows. Tasks return (dimensions + 1)^2 / 2 sums each, in limbs of 40 bits, and Spark adds them up; the driver
centres them as whole numbers, n * C - S S', before anything is rounded, and only then takes eigenvectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship_code, staged

SCALE, COMPONENTS = 256, 4
#: Rows of a block: 128 words a plane, so that all planes of some dozens of dimensions stay in a core's cache.
ROWS = 8192
_LIMB, _LIMBS = 40, 5
_MOST = 2**63 - 1


def quantised(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(key, x array<long>): x = floor(scale * c); rows whose vector is null or holds a null, NaN or infinite entry go.

    Products beyond a long's range become its least or greatest value.
    """
    ship_code(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("v").is_valid())
            column = batch.column("v")
            off, flat = column.offsets.to_numpy(), column.values
            c = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(c))])
            ok = bad[off[1:]] == bad[off[:-1]]
            with np.errstate(all="ignore"):
                y = np.floor(scale * c)
                x = np.where(y >= 2.0**63, _MOST, np.where(y < -(2.0**63), -(2**63), np.where(np.abs(y) < 2.0**63, y, 0).astype(np.int64)))
            rows = pa.ListArray.from_arrays(column.offsets, pa.array(x.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("k"), rows], ["k", "x"]).filter(pa.array(ok))

    given = vectors.select(F.col(key).cast("long").alias("k"), F.col(column).cast("array<double>").alias("v"))
    return given.mapInArrow(run, "k long, x array<long>").withColumnRenamed("k", key)


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    off = column.offsets.to_numpy()
    return column.values.to_numpy()[off[0] : off[-1]].reshape(len(column), dims)


def scatter(x: np.ndarray) -> np.ndarray:
    """Exact sums of products of all columns of a matrix of longs and a last one of ones, as a matrix of Python ints (upper half)."""
    n, dims = len(x), x.shape[1] + 1
    least = np.append(x.min(axis=0), 0)
    shifted = np.concatenate([x.view(np.uint64) - least[:-1].astype(np.int64).view(np.uint64), np.ones((n, 1), np.uint64)], axis=1)
    used = np.bitwise_or.reduce(shifted, axis=0)
    which = [(d, b) for d in range(dims) for b in range(int(used[d]).bit_length()) if int(used[d]) >> b & 1]
    dim, bit = (np.array(v, np.int64) for v in zip(*which))
    words = np.zeros((len(which), -(-n // 64) * 8), np.uint8)
    for p, (d, b) in enumerate(which):
        packed = np.packbits((shifted[:, d] >> np.uint64(b)).astype(np.uint8) & 1)
        words[p, : len(packed)] = packed
    planes = words.view(np.uint64)

    wide = 2 * int(bit.max()) + n.bit_length() + 8 > 62
    y = np.zeros((dims, dims), object if wide else np.int64)
    for p in range(len(which)):
        count = np.bitwise_count(planes[p:] & planes[p]).sum(axis=1, dtype=np.int64)
        count[1:][dim[p + 1 :] == dim[p]] *= 2  # a square has both orders of two of its planes
        weight = bit[p:] + bit[p]
        value = np.array([int(c) << int(w) for c, w in zip(count, weight)], object) if wide else count << weight
        at = np.flatnonzero(np.append(True, np.diff(dim[p:]) != 0))
        y[dim[p], dim[p:][at]] += np.add.reduceat(value, at)
    y, shift, own = y.astype(object), np.array([int(v) for v in least], object), y[:, -1].astype(object)
    out = y + np.outer(own, shift) + np.outer(shift, own) + n * np.outer(shift, shift)
    return np.triu(out)


def _scatters(dims: int, rows: int) -> Callable:
    upper = np.triu_indices(dims + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1), object)
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            for at in range(0, len(x), rows):
                total = total + scatter(np.ascontiguousarray(x[at : at + rows]))
        if not total[-1, -1]:
            return
        sums = total[upper].tolist()
        limbs = [[(v >> _LIMB * k) & (2**_LIMB - 1) if k < _LIMBS - 1 else v >> _LIMB * k for v in sums] for k in range(_LIMBS)]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()) for i in upper] + [pa.array(v, pa.int64()) for v in limbs], ["i", "j"] + [f"l{k}" for k in range(_LIMBS)])

    return run


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums S; unit eigenvectors as columns, by falling eigenvalue, and the trace of the covariance."""

    n: int
    sums: list[int]
    eigenvectors: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None

    def usable(self, k: int) -> bool:
        """Whether component k (from 0) has a direction: its eigenvalue isn't what rounding leaves of zero."""
        return self.eigenvalues[k] > self.eigenvalues[0] * len(self.sums) * np.finfo(float).eps

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """(x - S / n as doubles, sums over dimensions of (n * x - S)^2, null where they are beyond a long)."""
        largest = max([int(x.max()), -int(x.min())], default=0) if x.size else 0
        bound = self.n * largest + max([abs(s) for s in self.sums], default=0)
        if len(self.sums) * bound**2 <= _MOST:
            z = self.n * x - np.array(self.sums, np.int64)
            return z / self.n, (z * z).sum(axis=1).tolist()
        z = self.n * x.astype(object) - np.array(self.sums, object)
        squares = (z * z).sum(axis=1).tolist()
        return (z / self.n).astype(np.float64), [v if v <= _MOST else None for v in squares]

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened values, NaN for components without a direction."""
        with np.errstate(all="ignore"):
            scale = np.array([1 / np.sqrt(e) if self.usable(k) else np.nan for k, e in enumerate(self.eigenvalues)])
        return centred @ self.eigenvectors * scale


def _eigen(n: int, sums: list[int], products: dict[tuple[int, int], int], dims: int, components: int) -> Whitening:
    cov = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            cov[i, j] = cov[j, i] = (n * products[i, j] - sums[i] * sums[j]) / n**2  # whole numbers, rounded once
    trace = sum(n * products[i, i] - sums[i] ** 2 for i in range(dims)) / n**2
    values, vectors = np.linalg.eigh(cov)
    k = min(components, dims)
    return Whitening(n, sums, np.ascontiguousarray(vectors[:, ::-1][:, :k]), values[::-1][:k].copy(), trace)


def fit(x: DataFrame, dims: int, components: int = COMPONENTS, rows: int = ROWS) -> Whitening | None:
    """Whitening of the distinct vectors of `x` (x array<long>, all of `dims` entries); None if there is no row or no dimension."""
    once = staged(x.groupBy("x").agg(F.count("*").alias("copies")).select("x"), "distinct-vectors")
    parts = once.mapInArrow(_scatters(dims, rows), "i int, j int, " + ", ".join(f"l{k} long" for k in range(_LIMBS)))
    found = parts.groupBy("i", "j").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(_LIMBS))).collect()  # dims^2 / 2 rows
    products = {(r.i, r.j): sum(r[2 + k] << _LIMB * k for k in range(_LIMBS)) for r in found}
    if not dims or not products:
        return None
    model = _eigen(products[dims, dims], [products[i, dims] for i in range(dims)], products, dims, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays(list(map(pa.array, model.project(model.deviations(_matrix(batch.column("x"), dims))[0]).T)), [f"w{k}" for k in range(len(model.eigenvalues))])

    good = [k for k in range(len(model.eigenvalues)) if model.usable(k)]
    white = once.mapInArrow(run, ", ".join(f"w{k} double" for k in range(len(model.eigenvalues))))
    pairs = [(a, b) for a in good for b in good if a <= b]
    error = None
    if pairs:
        row = white.agg(*(F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs)).first()  # centred before it multiplies
        error = max(abs(row[f"c{a}_{b}"] - (a == b)) for a, b in pairs)
    return Whitening(model.n, model.sums, model.eigenvectors, model.eigenvalues, model.trace, error)


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), a row for each usable row and component.

    Rows whose vector is null or holds a null or non-finite entry are left out. Vectors shorter than the longest get zeros at
    their end. There are as many components as dimensions at most. Null and repeated keys give rows of their own. A component
    without variance (all rows of one vector, or fewer directions than components) has a null `whitened`; if the trace is zero
    `explained` is null, and without any usable component `identity_error` is. `deviation` is null where it is beyond a long.
    Other columns are ignored; an empty table, or vectors without entries, give an empty one.
    """
    rows = staged(quantised(vectors, key, column, scale), "quantised")
    least, dims = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != dims:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))))
    schema = f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows.select("x"), dims or 0, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k = len(model.eigenvalues)
    explained = [e / model.trace if model.trace > 0 else None for e in model.eigenvalues.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                centred, deviation = model.deviations(_matrix(part.column("x"), dims))
                white = model.project(centred).ravel()
                m = len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n, np.int64)),
                        pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                        pa.array(white, mask=np.isnan(white)),
                        pa.array(explained * m, pa.float64()),
                        pa.array([model.identity_error] * (m * k), pa.float64()),
                    ],
                    [f.split()[0] for f in schema.split(", ")],
                )

    return rows.mapInArrow(run, schema)
