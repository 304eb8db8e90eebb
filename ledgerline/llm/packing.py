"""Best-fit packing: documents' pieces into as few fixed-length sequences as best-fit decreasing finds.

Pieces of one length are interchangeable, so best-fit decreasing runs over the histogram of lengths (at most `capacity`
rows, whatever the corpus), with a segment tree over remaining capacities that finds the tightest open bin in
logarithmic time; bins with equal room are placed together, as runs. The plan that comes out says, for each length and
range of ranks, which sequences and offsets they take. Ranks and the join with the plan are Spark's.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import slices, text_buffer
from .shared import released, staged, texts
from .span_cache import shared_encoder

CAPACITY = 4096
#: Rows of one length that are ranked together; a length with more is dealt into parts, so that none is one task's.
PART_ROWS = 50_000


class OpenBins:
    """A segment tree over remaining capacities 0..capacity; a leaf holds the runs of bins with just that room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.runs: dict[int, deque] = {}

    def _mark(self, room: int, some: int) -> None:
        i = room + self.leaves
        self.some[i] = some
        while i > 1:
            i >>= 1
            self.some[i] = self.some[2 * i] | self.some[2 * i + 1]

    def push(self, room: int, first: int, n: int, front: bool = False) -> None:
        runs = self.runs.setdefault(room, deque())
        (runs.appendleft if front else runs.append)((first, n))
        if len(runs) == 1:
            self._mark(room, 1)

    def pop(self, room: int) -> tuple[int, int]:
        run = self.runs[room].popleft()
        if not self.runs[room]:
            self._mark(room, 0)
        return run

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of at least `size` that an open bin has."""
        i = size + self.leaves
        if self.some[i]:
            return size
        while i > 1:
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, per_bin, first_sequence, offset) of best-fit decreasing over `histogram`.

    The piece of that length with rank r in [rank_from, rank_to) goes to sequence first_sequence + (r - rank_from) //
    per_bin, at offset + (r - rank_from) % per_bin * length. As no open bin between `length` and the tightest room
    exists, best fit puts the next equal piece into the same bin while it fits; so whole bins are filled at once.
    """
    bins, plan, used = OpenBins(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def place(first: int, n_bins: int, per: int, room: int) -> None:
            nonlocal rank, left
            plan.append((length, rank, rank + n_bins * per, per, first, capacity - room))
            rank, left = rank + n_bins * per, left - n_bins * per
            bins.push(room - per * length, first, n_bins)

        while left:
            room = bins.tightest(length)
            if room is None:
                room, first, n = capacity, used, -(-left // (capacity // length))
                used += n
            else:
                first, n = bins.pop(room)
            per = room // length
            whole = min(n, left // per)
            if whole:
                place(first, whole, per, room)
            if whole < n and left:
                place(first + whole, 1, left, room)
                whole += 1
            if whole < n:
                bins.push(room, first + whole, n - whole, front=True)
    return plan


def _pieces(json, spans: str, end_id: int, capacity: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(json, spans)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, at = encoder(*text_buffer(batch.column("text")), end_id)
                n = -(-np.diff(at) // capacity)
                row = np.repeat(np.arange(len(batch)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(at)[row] - start)
                view = memoryview(ids.astype("<u4").tobytes())
                begin = at[:-1][row] + start
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
                columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cuts = np.concatenate([begin, [len(ids)]]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pack(documents: DataFrame, tokenizer_json: str, end_id: int, capacity: int = CAPACITY, spans: str = "words", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids where asked for), a row per piece.

    A null text is empty and takes one end id. Null and repeated doc_ids are packed like any other row. Other columns
    are ignored. An empty table gives an empty one. Sequences are gapless from offset 0.
    """
    spark = documents.sparkSession
    docs = texts(documents)
    json = spark.sparkContext.broadcast(tokenizer_json)
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = staged(docs.mapInArrow(released(_pieces(json, spans, end_id, capacity, with_ids)), kind), "pieces")

    histogram = dict(pieces.groupBy("length").count().collect())  # at most `capacity` rows
    plan = spark.createDataFrame(best_fit(histogram, capacity), "plan_length long, rank_from long, rank_to long, per_bin long, first_sequence long, offset long")

    parts = spark.createDataFrame([(n, -(-c // PART_ROWS)) for n, c in histogram.items()], "length long, parts long")
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts"))).drop("parts")  # at most `capacity` rows
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))  # a row for PART_ROWS pieces
    before = counts.select("length", "part", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    meets = (F.col("length") == F.col("plan_length")) & (F.col("rank_from") < F.col("before") + F.col("n")) & (F.col("rank_to") > F.col("before"))
    cut = before.join(plan, meets).select("length", "part", "before", *plan.columns[1:])  # each part's share of the plan
    cut = cut.groupBy("length", "part", "before").agg(F.array_sort(F.collect_list(F.struct(*plan.columns[1:]))).alias("runs"))
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(cut, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    run = F.get(F.filter("runs", lambda r: (r["rank_from"] <= F.col("rank")) & (F.col("rank") < r["rank_to"])), F.lit(0))
    placed = ranked.withColumn("run", run).select(*dealt.columns, "rank", "run.*")
    nth = F.col("rank") - F.col("rank_from")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids,
        (F.col("first_sequence") + F.floor(nth / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("offset") + nth % F.col("per_bin") * F.col("length")).cast("long").alias("offset"),
    )
