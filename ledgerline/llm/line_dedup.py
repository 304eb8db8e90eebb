"""Passages that repeat across documents: pairwise patience alignment of later documents with earlier ones.

A window is a run of LEAST words. A word of a document goes if it lies in a window that an earlier document has too.

Documents that may overlap are found by rare shared runs: each window's anchor is the run of ANCHOR words in it with the
least hash, so equal windows have equal anchors, whatever is around them. A document is paired with the earliest document
of each of its windows that begin with an anchor - links in number of anchors, however many documents share one. Each pair
is aligned by patience: blocks around shared anchors, extended both ways word by word, are taken in rising order in both (a
longest increasing subsequence), then those that moved or repeat, and what shared anchors miss is found by its windows.
What has been aligned is compared byte by byte. Windows that then lie in no aligned block, and whose anchor another document has, look
for their earliest document in the same way, and those pairs are aligned too; so no window that repeats is left.
Documents with the text of an earlier one go as a whole, without alignment.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import NOT_SPACE, ODD, Words, mix, slices, span_hashes, text_buffer
from .shared import bitmap, in_bitmap, passing, released, screened, staged, texts

ANCHOR, LEAST = 12, 50
SLICE = 1 << 18  # bytes of text that are hashed at once: what that takes stays in a core's cache
_BLOCKS = "array<struct<from: int, to: int>>"
_SPANS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def _over(x: np.ndarray, n: int, what: np.ufunc) -> np.ndarray:
    """The minimum or maximum of each n values in a row."""
    k = 1
    while 2 * k <= n:
        x = what(x[:-k], x[k:])
        k *= 2
    return what(x[: len(x) - (n - k)], x[n - k :])


_STEP = int(ODD[2])
_BACK = pow(_STEP, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers 0 to n - 1 (at least) of an odd number and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(2 * n, base, np.uint64)), dtype=np.uint64) for base in (_STEP, _BACK)]
    return _powers


def _sums(words: np.ndarray) -> np.ndarray:
    """Sums of the words' hashes, each times a power that its place gives."""
    return np.append(np.uint64(0), np.cumsum(words * _powers_to(len(words))[0][: len(words)], dtype=np.uint64))


def _runs(sums: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words: differences of sums, moved back to the run's beginning, so that equal runs are equal everywhere."""
    total = len(sums) - n
    if total <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[n:] - sums[:-n]) * _powers_to(total)[1][:total] + np.uint64(n))


class Texts:
    """Several texts' words; text i has words first[i]:first[i + 1].

    Window s begins with word s; where `inside` is False it would pass its text's end. `anchor` is the least hash of the
    runs of n words in it, `window` its own hash.
    """

    def __init__(self, column: pa.Array, n: int, least: int):
        self.data, self.offsets = text_buffer(column)
        words = Words(self.data, self.offsets, NOT_SPACE)
        self.start, self.end, self.first, self.n, self.least = words.start, words.end, words.first, n, least
        self.word = span_hashes(self.data, words.start, words.end)
        sums = _sums(self.word)
        self.runs, self.window = _runs(sums, n), _runs(sums, least)
        self.anchor = _over(self.runs, least - n + 1, np.minimum) if len(self.window) else self.window
        self.inside = np.arange(len(self.window)) + least <= np.repeat(self.first[1:], np.diff(self.first))[: len(self.window)]

    def anchors(self) -> np.ndarray:
        """The words that anchors begin with, ties included."""
        if not len(self.anchor):
            return np.zeros(0, np.int64)
        edge = np.zeros(self.least - self.n, np.uint64)
        known = np.where(self.inside, self.anchor, np.uint64(0))
        return np.flatnonzero(_over(np.concatenate([edge, known, edge]), self.least - self.n + 1, np.maximum) == self.runs)

    def of(self, words: np.ndarray) -> np.ndarray:
        """The texts that words are in."""
        return np.searchsorted(self.first, words, "right") - 1

    def raw(self, a: int, b: int) -> bytes:
        """The bytes of words a to b, b not included, and of what lies between them."""
        return self.data[self.start[a] : self.end[b - 1]].tobytes()


def _lists(text: np.ndarray, key: np.ndarray, rows: int) -> pa.ListArray:
    """The distinct keys of each text."""
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]))) if len(key) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[new], np.arange(rows + 1)).astype(np.int32)), pa.array(key[new].view(np.int64)))


def _anchored(n: int, least: int) -> Callable:
    """(doc_id, uid, n_words, digest, anchors, windows): anchors, and the windows that begin with one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                t = Texts(batch.column("text"), n, least)
                at = t.anchors()
                begin = at[at < len(t.inside)]
                begin = begin[t.inside[begin]]
                raw, cuts = memoryview(t.data), t.offsets.tolist()
                digest = pa.array([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(cuts, cuts[1:])], pa.binary())
                lists = [_lists(t.of(at), t.runs[at], len(batch)), _lists(t.of(begin), t.window[begin], len(batch))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), pa.array(np.diff(t.first)), digest, *lists], ["doc_id", "uid", "n_words", "digest", "anchors", "windows"])

    return run


def _wanted_windows(wanted) -> Callable:
    """(window, doc_id, uid) of the windows that may be in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("windows")
            cut = column.offsets.to_numpy()
            found = column.values.to_numpy()[cut[0] : cut[-1]]
            keep = in_bitmap(wanted.value, found)
            at = pa.array(np.repeat(np.arange(len(batch)), np.diff(cut))[keep])
            yield pa.RecordBatch.from_arrays([pa.array(found[keep]), batch.column("doc_id").take(at), batch.column("uid").take(at)], ["window", "doc_id", "uid"])

    return run


def _sharing(shared) -> Callable:
    """uid of the rows one of whose anchors may be in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("anchors")
            cut = column.offsets.to_numpy()
            hits = np.concatenate([[0], np.cumsum(in_bitmap(shared.value, column.values.to_numpy()[cut[0] : cut[-1]]))])[cut - cut[0]]
            yield pa.RecordBatch.from_arrays([batch.column("uid").filter(pa.array(np.diff(hits) > 0))], ["uid"])

    return run


def _open_windows(shared, tests: tuple, n: int, least: int) -> Callable:
    """(doc_id, uid, windows): windows that lie in no block and whose anchor may be shared, of rows that pass the tests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(pa.array(passing(whole, tests)))
            for batch in slices(whole, "text", SLICE):
                t = Texts(batch.column("text"), n, least)
                free = t.inside & in_bitmap(shared.value, t.anchor.view(np.int64))
                if "blocks" in batch.schema.names:
                    for i, blocks in enumerate(batch.column("blocks").to_pylist()):
                        for block in blocks or ():
                            free[t.first[i] + block["from"] : max(0, t.first[i] + block["to"] - least + 1)] = False
                at = np.flatnonzero(free)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), _lists(t.of(at), t.window[at], len(batch))], ["doc_id", "uid", "windows"])

    return run


def _same(a: np.ndarray, b: np.ndarray, step: int = 64) -> int:
    """How many leading values are equal."""
    n, at = min(len(a), len(b)), 0
    while at < n:
        differ = a[at : min(at + step, n)] != b[at : min(at + step, n)]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = at + step, 2 * step
    return n


def _extended(later: np.ndarray, earlier: np.ndarray, shared: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Blocks (from, to, place in the earlier text) of at least `least` words around pairs of places; pairs in one block give it once."""
    out, diagonal, done = [], None, 0
    for i, j in sorted(shared, key=lambda x: (x[1] - x[0], x[0])):
        if j - i != diagonal:
            diagonal, done = j - i, 0
        if i < done:
            continue
        n = min(i - done, j)
        a, b = i - _same(later[i - n : i][::-1], earlier[j - n : j][::-1]), i + _same(later[i:], earlier[j:])
        done = max(b, i + 1)
        if b - a >= least:
            out.append((a, b, a + diagonal))
    return out


def patience(blocks: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The longest chain of blocks that rises in both texts, then the others, which moved or repeat."""
    blocks = sorted(blocks)
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(blocks)
    for k, (_, _, place) in enumerate(blocks):
        x = bisect_left(tails, place)
        back[k] = ends[x - 1] if x else -1
        tails[x : x + 1], ends[x : x + 1] = [place], [k]
    k, chain = ends[-1] if ends else -1, []
    while k >= 0:
        chain.append(k)
        k = back[k]
    return [blocks[k] for k in reversed(chain)] + [blocks[k] for k in sorted(set(range(len(blocks))) - set(chain))]


class _Earlier:
    """Anchors and windows of one of the earlier texts."""

    def __init__(self, texts_: Texts, anchors: np.ndarray, i: int):
        self.a, self.b, least = int(texts_.first[i]), int(texts_.first[i + 1]), texts_.least
        self.word = texts_.word[self.a : self.b]
        at = anchors[np.searchsorted(anchors, self.a) : np.searchsorted(anchors, self.b)]
        self.place = dict(zip(texts_.runs[at][::-1].tolist(), (at[::-1] - self.a).tolist()))  # the first one of each anchor
        window = texts_.window[self.a : max(self.a, self.b - least + 1)]
        self.order = np.argsort(window, kind="stable")
        self.window = window[self.order]

    def find(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the windows this text has, where)."""
        if not len(self.window):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.window, windows), len(self.window) - 1)
        hit = np.flatnonzero(self.window[at] == windows)
        return hit, self.order[at[hit]]


def _equal_parts(own: list[bytes], other: list[bytes], least: int) -> list[tuple[int, int]]:
    """Where two lists of words of one length are equal for `least` words or more."""
    if own == other:
        return [(0, len(own))] if len(own) >= least else []
    mark = np.zeros(len(own) + 2, np.int8)
    mark[1:-1] = [x == y for x, y in zip(own, other)]
    return [(a, b) for a, b in np.flatnonzero(np.diff(mark)).reshape(-1, 2).tolist() if b - a >= least]


def aligned_blocks(later: Texts, anchors: np.ndarray, i: int, earlier: Texts, other: _Earlier) -> list[tuple[int, int]]:
    """Blocks of `least` words or more of the i-th later text that the earlier one has, compared by their bytes."""
    first, end, least = int(later.first[i]), int(later.first[i + 1]), later.least
    at = anchors[np.searchsorted(anchors, first) : np.searchsorted(anchors, end)]
    seeds = [(x - first, other.place[a]) for x, a in zip(at.tolist(), later.runs[at].tolist()) if a in other.place]
    out: list[tuple[int, int]] = []
    free = np.ones(max(0, end - first - least + 1), bool)

    def add(a: int, b: int, c: int) -> None:
        own, theirs = later.raw(first + a, first + b), earlier.raw(other.a + c, other.a + c + b - a)
        found = [(0, b - a)] if own == theirs and b - a >= least else _equal_parts(own.split(), theirs.split(), least)
        for x, y in found:
            out.append((a + x, a + y))
            free[a + x : a + y - least + 1] = False

    for a, b, c in patience(_extended(later.word[first:end], other.word, seeds, least)):
        if free[a : b - least + 1].any():
            add(a, b, c)
    begin = np.flatnonzero(free)
    hit, where = other.find(later.window[first + begin])
    begin = begin[hit]
    new = np.flatnonzero(np.append(True, (np.diff(begin) != 1) | (np.diff(where) != 1))) if len(begin) else begin
    for x, y in zip(new.tolist(), [*new[1:].tolist(), len(begin)]):
        add(int(begin[x]), int(begin[y - 1]) + least, int(where[x]))
    return out


def _aligned(n: int, least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                numbered = batch.column("text2").dictionary_encode()  # rows with one partner lie together
                later, earlier = Texts(batch.column("text"), n, least), Texts(numbered.dictionary, n, least)
                mine, theirs, known = later.anchors(), earlier.anchors(), {}
                out = []
                for i, j in enumerate(numbered.indices.to_pylist()):
                    if j not in known:
                        known[j] = _Earlier(earlier, theirs, j)
                    out.append([{"from": a, "to": b} for a, b in aligned_blocks(later, mine, i, earlier, known[j])])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), pa.array(out, _SPANS)], ["doc_id", "uid", "blocks"])

    return run


def _cut(least: int) -> Callable:
    """(doc_id, uid, text that is left, removed_words, removed_blocks) of rows with `blocks` to go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offsets = text_buffer(batch.column("text"))
                words = Words(data, offsets, NOT_SPACE)
                texts_, gone_words, gone_blocks = batch.column("text").to_pylist(), np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
                for i, blocks in enumerate(batch.column("blocks").to_pylist()):
                    if not blocks:
                        continue
                    mark = np.zeros(int(words.count[i]) + 2, np.int8)
                    for block in blocks:
                        mark[block["from"] + 1 : block["to"] + 1] = 1
                    edge = np.flatnonzero(np.diff(mark)).reshape(-1, 2)
                    first, at, parts = int(words.first[i]), int(offsets[i]), []
                    for a, b in edge[edge[:, 1] - edge[:, 0] >= least].tolist():
                        parts.append(data[at : words.start[first + a]].tobytes())
                        at = int(words.start[first + b]) if b < words.count[i] else int(offsets[i + 1])
                        gone_words[i] += b - a
                        gone_blocks[i] += 1
                    if gone_blocks[i]:
                        texts_[i] = b"".join([*parts, data[at : offsets[i + 1]].tobytes()]).decode().rstrip(" \t\n\v\f\r")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("uid"), pa.array(texts_, pa.string()), pa.array(gone_words), pa.array(gone_blocks)],
                    ["doc_id", "uid", "text", "removed_words", "removed_blocks"],
                )

    return run


def _several(each: DataFrame, key: str) -> DataFrame:
    """(key, doc_id2): the keys that documents of several ids have, with the least id. Staged, so that a join with it can be split."""
    found = each.groupBy(key).agg(F.min("doc_id").alias("doc_id2"), F.max("doc_id").alias("last")).where("doc_id2 < last")
    return staged(found.drop("last"), "shared")


def _pairs(windows: DataFrame) -> DataFrame:
    """(doc_id, uid, doc_id2): documents (doc_id, uid, windows) with the earliest document of each window, where that is another."""
    sc = windows.sparkSession.sparkContext
    first = _several(windows.select("doc_id", F.explode("windows").alias("window")), "window")
    wanted = sc.broadcast(bitmap(first, "window"))
    again = windows.mapInArrow(released(_wanted_windows(wanted)), "window long, doc_id long, uid long")
    out = staged(again.join(first, "window").where("doc_id2 < doc_id").select("doc_id", "uid", "doc_id2").distinct(), "pairs")
    wanted.unpersist()
    return out


def _blocks(pairs: DataFrame, known: DataFrame, repeated: Broadcast, n: int, least: int) -> DataFrame:
    """(doc_id, uid, blocks): what aligns in each pair. Partners are all texts with their id; `repeated` tells rows that may occur twice."""
    sc = pairs.sparkSession.sparkContext
    some = sc.broadcast(bitmap(pairs.select(F.explode(F.array("doc_id", "doc_id2")).alias("doc_id")).distinct(), "doc_id"))
    # One row of each text, in a table of its own: a document that is many others' partner is a hot key, which joins of tables split.
    rows = screened(known, (some, "doc_id", True), (repeated, "uid", False))
    if repeated.value.any():  # else no second pass over the texts
        rows = rows.unionByName(screened(known, (some, "doc_id", True), (repeated, "uid", True)).dropDuplicates(["doc_id", "uid"]))
    rows = staged(rows, "texts")
    some.unpersist()
    partner = rows.select(F.col("doc_id").alias("doc_id2"), F.col("text").alias("text2"))
    both = pairs.join(rows, ["doc_id", "uid"]).join(partner, "doc_id2").select("doc_id", "uid", "text", "text2")
    found = both.mapInArrow(released(_aligned(n, least)), f"doc_id long, uid long, blocks {_BLOCKS}")
    return staged(found.where(F.size("blocks") > 0), "blocks")


def dedup_lines(documents: DataFrame, anchor_words: int = ANCHOR, least_words: int = LEAST) -> DataFrame:
    """(doc_id, uid, text, removed_words, removed_blocks), a row for each row of `documents` (doc_id, text).

    Earlier means a smaller doc_id. A text all of which repeats becomes empty; texts without repeats, nulls included, stay
    as they are. A null doc_id is neither earlier nor later than any: its text stays. Rows that repeat a doc_id don't
    count against each other; if their texts differ, each is cut by itself, and each counts as earlier for larger ids.
    uid is a hash of doc_id and text. Other columns are ignored; an empty table gives an empty one.
    """
    docs = texts(documents).withColumn("uid", F.xxhash64("doc_id", "text"))
    sc = documents.sparkSession.sparkContext
    known = docs.where("doc_id is not null and text is not null")
    kind = "doc_id long, uid long, n_words long, digest binary, anchors array<long>, windows array<long>"
    found = staged(known.mapInArrow(released(_anchored(anchor_words, least_words)), kind), "anchors")

    same = found.where(F.col("n_words") >= least_words).select("doc_id", "uid", "n_words", "digest")
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("n_words").cast("int").alias("to")))
    copies = staged(same.join(_several(same, "digest"), "digest").where("doc_id2 < doc_id").select("doc_id", "uid", whole.alias("blocks")).distinct(), "copies")
    pairs = staged(_pairs(found).join(copies, ["doc_id", "uid"], "left_anti"), "pairs")
    repeated = sc.broadcast(bitmap(found.groupBy("doc_id", "uid").agg(F.count("*").alias("n")).where("n > 1"), "uid"))
    blocks = copies.unionByName(_blocks(pairs, known, repeated, anchor_words, least_words))

    # The earliest document that has a window never has it in a block, so the windows outside of blocks are enough.
    shared = sc.broadcast(bitmap(_several(found.select("doc_id", F.explode("anchors").alias("anchor")), "anchor"), "anchor"))
    gathered = lambda rows: rows.groupBy("doc_id", "uid").agg(F.flatten(F.collect_list("blocks")).alias("blocks"))
    first = staged(gathered(blocks), "blocks")
    in_blocks = sc.broadcast(bitmap(first, "uid"))
    sharing = sc.broadcast(bitmap(found.select("uid", "anchors").mapInArrow(released(_sharing(shared)), "uid long"), "uid"))
    open_windows, row = lambda *tests: released(_open_windows(shared, tests, anchor_words, least_words)), "doc_id long, uid long, windows array<long>"
    some = screened(known, (in_blocks, "uid", True), (sharing, "uid", True)).join(first, ["doc_id", "uid"], "left").mapInArrow(open_windows(), row)
    others = known.mapInArrow(open_windows((in_blocks, "uid", False), (sharing, "uid", True)), row)
    rest = staged(some.unionByName(others).where(F.size("windows") > 0), "rest")
    for bits in (shared, sharing, in_blocks):
        bits.unpersist()
    more = _pairs(rest)
    if not more.isEmpty():
        first = staged(gathered(first.unionByName(_blocks(more, known, repeated, anchor_words, least_words))), "blocks")

    with_blocks = sc.broadcast(bitmap(first, "uid"))
    touched = screened(docs, (with_blocks, "uid", True)).join(first, ["doc_id", "uid"], "left").select("doc_id", "uid", "text", "blocks")
    others = screened(docs, (with_blocks, "uid", False))
    zero = F.lit(0).cast("long")
    cut = touched.mapInArrow(released(_cut(least_words)), "doc_id long, uid long, text string, removed_words long, removed_blocks long")
    return cut.unionByName(others.withColumns({"removed_words": zero, "removed_blocks": zero}))
