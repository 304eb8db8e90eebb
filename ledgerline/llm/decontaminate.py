"""Benchmark contamination: a prefix-filtered set join of document words with the items' word windows.

A window is contained only if its shingles all are, so for containment the necessary prefix is one shingle: the one
that fewest shingles of the corpus equal (ties by hash, so that neighbouring windows choose alike). Documents emit only
places with such a shingle, with the words around; the join adds positional and length bounds and compares the words.
Bitmaps of bounded size keep other shingles from being shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import ALNUM, LOWER, Words, grams, slices, span_hashes, text_buffer
from .shared import bitmap, in_bitmap, released, staged, texts

WINDOW, GRAM = 13, 3
_PLACES = pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int32()), ("first", pa.int64()), ("words", pa.string())]))


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, Words, np.ndarray]:
    data, offsets = text_buffer(batch.column("text"))
    data = LOWER[data]
    words = Words(data, offsets, ALNUM)
    return data, words, span_hashes(data, words.start, words.end)


def _shingles(hashes: np.ndarray, words: Words, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its first word) of the shingles of each of the sizes."""
    parts = [grams(hashes, words.first, g) for g in sizes]
    return np.concatenate([h for h, _ in parts]).view(np.int64), np.concatenate([at for _, at in parts])


def _windows(size: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, words, hashes = _words(batch)
                raw, rows = data.tobytes(), []
                spans = [raw[a:b] for a, b in zip(words.start.tolist(), words.end.tolist())]
                for item, a, b in zip(batch.column("item_id").to_pylist(), words.first[:-1].tolist(), words.first[1:].tolist()):
                    n = min(size, b - a)
                    g = min(gram, n)
                    for at in range(a, b - n + 1) if n else ():
                        own, _ = grams(hashes[at : at + n], np.array([0, n]), g)
                        rows.append({"item_id": item, "window": b" ".join(spans[at : at + n]).decode(), "n": n, "g": g, "grams": own.view(np.int64).tolist()})
                yield pa.RecordBatch.from_pylist(rows, _WINDOWS)

    return run


_WINDOWS = pa.schema([("item_id", pa.int64()), ("window", pa.string()), ("n", pa.int32()), ("g", pa.int32()), ("grams", pa.list_(pa.int64()))])


def _counted(wanted, sizes: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                _, words, hashes = _words(batch)
                found, _ = _shingles(hashes, words, sizes)
                gram, n = np.unique(found[in_bitmap(wanted.value, found)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], ["gram", "n"])

    return run


def _placed(wanted, sizes: list[int], size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, words, hashes = _words(batch)
                found, at = _shingles(hashes, words, sizes)
                hit = np.flatnonzero(in_bitmap(wanted.value, found))
                doc = np.searchsorted(words.first, at[hit], "right") - 1
                places: list[list | None] = [None] * len(batch)
                for gram, w, d in zip(found[hit].tolist(), at[hit].tolist(), doc.tolist()):
                    a, b = max(int(words.first[d]), w - size + 1), min(int(words.first[d + 1]), w + size)
                    near = b" ".join(data[x:y].tobytes() for x, y in zip(words.start[a:b].tolist(), words.end[a:b].tolist())).decode()
                    if places[d] is None:
                        places[d] = []
                    places[d].append({"gram": gram, "at": w - a, "first": a - int(words.first[d]), "words": near})
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), pa.array(words.count), pa.array(places, _PLACES)], ["doc_id", "uid", "n_words", "places"])

    return run


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, uid), a row for each row of `documents` (doc_id, text).

    uid is a hash of doc_id and text; rows are told apart by doc_id and uid together.

    `benchmark` has item_id and text. Texts without words, null ones too, have no windows and no hits. Items with a null
    item_id make hits but aren't counted or listed; repeated items count once. Rows that repeat a doc_id are judged by
    their own text. Other columns are ignored. With an empty benchmark nothing is hit; no documents give no rows.
    """
    docs = texts(documents).withColumn("uid", F.xxhash64("doc_id", "text"))
    spark = documents.sparkSession
    windows = staged(texts(benchmark, "item_id").mapInArrow(released(_windows(window, gram)), "item_id long, window string, n int, g int, grams array<long>"), "windows")
    sizes = sorted(r.g for r in windows.select("g").distinct().collect()) or [gram]  # at most `gram` values

    each = windows.select("window", "n", F.posexplode("grams").alias("offset", "gram")).distinct()
    every = spark.sparkContext.broadcast(bitmap(each, "gram"))
    counts = docs.select("text").mapInArrow(released(_counted(every, sizes)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("in_corpus"))
    known = each.join(counts, "gram")  # a window with a shingle that the corpus lacks can't occur ...
    complete = F.count("*") == F.min("n") - F.min(F.least("n", F.lit(gram))) + 1  # ... and is dropped here
    rarest = known.groupBy("window").agg(F.min("n").alias("n"), F.min(F.struct("in_corpus", "gram", "offset")).alias("r"), complete.alias("complete"))
    prefix = staged(rarest.where("complete").select("window", "n", "r.gram", "r.offset"), "prefix")

    every.unpersist()
    wanted = spark.sparkContext.broadcast(bitmap(prefix, "gram"))
    placed = staged(docs.mapInArrow(released(_placed(wanted, sizes, window)), "doc_id long, uid long, n_words long, places array<struct<gram: long, at: int, first: long, words: string>>"), "places")

    wanted.unpersist()
    spots = placed.where("places is not null").select("doc_id", "uid", F.explode("places").alias("p")).select("doc_id", "uid", "p.*").distinct()
    start = F.col("at") - F.col("offset")
    same = F.array_join(F.slice(F.split("words", " "), start + 1, F.col("n")), " ") == F.col("window")
    found = spots.join(prefix, "gram").where(start >= 0).where(same)
    found = staged(found.select("doc_id", "uid", (F.col("first") + start).alias("start"), "n", "window").distinct(), "found")

    spans = found.groupBy("doc_id", "uid", "start").agg((F.col("start") + F.max("n")).alias("end"))
    before = Window.partitionBy("doc_id", "uid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    hits = spans.select("doc_id", "uid", fresh.alias("fresh")).groupBy("doc_id", "uid").agg(F.sum("fresh").alias("n_hit"))
    items = found.select("doc_id", "uid", "window").distinct().join(windows.select("item_id", "window").where("item_id is not null").distinct(), "window")
    items = items.select("doc_id", "uid", F.col("item_id").cast("string").alias("item")).distinct().groupBy("doc_id", "uid").agg(F.array_sort(F.collect_list("item")).alias("items"))

    out = placed.select("doc_id", "uid", "n_words")
    for part in (hits, items):
        part = part.withColumnsRenamed({"doc_id": "of_doc", "uid": "of_uid"})
        out = out.join(part, out["doc_id"].eqNullSafe(part["of_doc"]) & (out["uid"] == part["of_uid"]), "left").drop("of_doc", "of_uid")
    n_hit, listed = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "uid",
    )
