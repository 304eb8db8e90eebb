"""Numpy helpers over Arrow string columns: word spans and 64-bit hashes without a Python object per word.

A batch's texts lie end to end in one byte buffer; `offsets[i]:offsets[i + 1]` is text i. Nulls are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEED = np.random.default_rng(20240229)
STEP = np.uint64(0x9E3779B97F4A7C15)
ODD = _SEED.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)  # bytes outside \x00-\x2F \x3A-\x60 \x7B-\x7F, with A-Z as they are lower-cased
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place on a fresh uint64 array."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are of length 0."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about max_bytes of text each (one row at least)."""
    _, offsets = text_buffer(batch.column(column))
    at = 0
    while at < len(batch):
        to = int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1
        to = min(max(to, at + 1), len(batch))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Word spans of a batch: `start`, `end` in the buffer; words of text i are first[i]:first[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        inside = is_word[data]
        cut = offsets[(offsets > 0) & (offsets < len(data))]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        opens[cut] = inside[cut]
        closes[cut - 1] = inside[cut - 1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: the sum of its pieces of 8 bytes, each mixed with its place in the span.

    As pieces are mixed before they are summed, different spans have equal hashes only by chance.
    """
    size = np.asarray(end - start, np.int64)
    out = size.astype(np.uint64) * ODD[0]
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", raw, strides=(1,))  # the 8 bytes from each place on

    def pieces(span: np.ndarray, nth: np.ndarray) -> np.ndarray:
        left = size[span] - 8 * nth
        here = eight[start[span] + 8 * nth]
        short = np.flatnonzero(left < 8)
        here[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        place = STEP * (nth + 1).astype(np.uint64)
        return mix((here ^ place) * ODD[1] + place)

    some, nth = np.flatnonzero(size > 0), 0
    while len(some) > 64:  # most spans are words of a piece or two
        out[some] += pieces(some, np.full(len(some), nth))
        nth += 1
        some = some[size[some] > 8 * nth]
    if len(some):
        n = -(-size[some] // 8) - nth
        span = np.repeat(some, n)
        np.add.at(out, span, pieces(span, nth + np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n)))
    return mix(out)


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word runs and the index of the word that each begins with; runs stay within a text."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = hashes[: len(hashes) - n + 1] * ODD[1]
    for j in range(1, n):
        total += hashes[j : len(hashes) - n + 1 + j] * ODD[j + 1]
    ok = np.ones(len(total), bool)
    for j in range(1, n):  # runs that would reach over a text's end
        last = first[1:] - j
        ok[last[(last >= 0) & (last < len(ok))]] = False
    begin = np.flatnonzero(ok)
    return mix(total[begin] + np.uint64(n)), begin
