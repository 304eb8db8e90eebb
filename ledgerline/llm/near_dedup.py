"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification on full shingle sets, union-find.

Texts with the same shingle set fall into one class by a 128-bit digest of the set, and only a class's least doc_id goes
on, so copies cost one row each. Within a bucket nothing is paired all against all: first each member is held against
the bucket's most shared member. Only members of buckets that then still span several components go through an exact
prefix-filtered join with length and positional bounds, which finds every link that is left between components.
A link is missed only if no band of the two signatures agrees: for similarity 0.75, (1 - 0.75^4)^32, about 5 in a million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, NOT_SPACE, ODD, STEP, Words, grams, mix, slices, span_hashes, text_buffer
from .components import components
from .shared import bitmap, in_bitmap, released, staged, texts

WORDS, BANDS, ROWS = 5, 32, 4
SLICE = 1 << 18  # bytes of text whose signatures are made at once: each shingle takes 2 bytes for each slot meanwhile
_TO_UNIT = 2.0**-53


def shingle_sets(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """For each row, the sorted distinct hashes of its n-word shingles; a shorter text is one shingle, no words none."""
    data, offsets = text_buffer(batch.column("text"))
    data = LOWER[data]
    words = Words(data, offsets, NOT_SPACE)
    hashes = span_hashes(data, words.start, words.end)
    all_grams, begin = grams(hashes, words.first, n)
    cut = np.searchsorted(begin, words.first)
    out = [np.unique(all_grams[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
    for i in np.flatnonzero((words.count > 0) & (words.count < n)).tolist():
        own = hashes[words.first[i] : words.first[i + 1]]
        out[i] = mix(np.array([(own * ODD[1 : len(own) + 1]).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64))
    return out


def _stream(i: int) -> np.uint64:
    return np.uint64(int(STEP) * i % 2**64)


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash (Ertl 2017) signatures of m slots, all elements of all sets at once, level by level.

    At level j an element draws the next slot of its own random permutation of 0..m-1 (Fisher-Yates, one swap a level)
    and offers the value j + r with r in [0, 1). A set stops once every slot has a value below j + 1, since later levels
    can only offer more. Sets must not be empty.
    """
    size = np.array([len(s) for s in sets])
    sig = np.full(len(sets) * m, np.inf)
    if not len(sets):
        return sig.reshape(0, m)
    element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = None  # each element's permutation so far, made when a second level is needed
    for j in range(m):
        draw = mix(element + _stream(2 * j + 1))
        value = (draw >> np.uint64(11)).astype(np.float64) * _TO_UNIT + j
        k = j + (mix(element + _stream(2 * j + 2)) % np.uint64(m - j)).astype(np.int64)
        rows = np.arange(len(element))
        if order is None:
            slot = k
        else:
            slot = order[rows, k].astype(np.int64)
            order[rows, k] = order[rows, j]
        np.minimum.at(sig, owner * m + slot, value)
        full = (sig.reshape(-1, m) < j + 1).all(axis=1)
        on = ~full[owner]
        if not on.any():
            break
        if order is None:
            order = np.tile(np.arange(m, dtype=np.uint16), (int(on.sum()), 1))
            at = np.arange(len(order))
            order[at, k[on]] = 0
        else:
            order = order[on]
        element, owner = element[on], owner[on]
    return sig.reshape(-1, m)


def _signatures(n: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                sets = shingle_sets(batch, n)
                some = [i for i, s in enumerate(sets) if len(s)]
                sig = superminhash([sets[i] for i in some], bands * rows).view(np.uint64).reshape(len(some), bands, rows)
                key = mix((sig * ODD[:rows]).sum(axis=2, dtype=np.uint64) + ODD[32:33] * np.arange(bands, dtype=np.uint64)).view(np.int64)
                where = {i: x for x, i in enumerate(some)}
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("uid"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        pa.array([key[where[i]] if i in where else None for i in range(len(sets))], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "uid", "n_shingles", "digest", "bands"],
                )

    return run


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sets(n: int, wanted) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = batch.column("doc_id").fill_null(0).to_numpy()
                batch = batch.filter(pa.array(in_bitmap(wanted.value, ids) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)))
                if len(batch):
                    sets = shingle_sets(batch, n)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "digest", "s"])

    return run


def _sets_of(ids: DataFrame, classes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(id, s): the full shingle sets of the classes whose least doc_id is in `ids`, computed again from the texts.

    Texts that share a doc_id are classes of their own, so an id may have several sets.
    """
    sc = docs.sparkSession.sparkContext
    wanted = sc.broadcast(bitmap(ids, "id"))
    sets = docs.mapInArrow(released(_sets(n, wanted)), "id long, digest binary, s array<long>")
    own = classes.select(F.col("rep").alias("id"), "digest").join(ids, "id", "left_semi")
    out = staged(sets.join(own, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]).drop("digest"), "sets")
    wanted.unpersist()
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v), those whose full shingle sets have intersection >= percent % of union."""
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col("id").alias("v"), F.col("s").alias("sv")), "v")
    shared = F.size(F.array_intersect("su", "sv"))
    fits = 100 * F.least(F.size("su"), F.size("sv")) >= percent * F.greatest(F.size("su"), F.size("sv"))
    return both.where(fits).where(100 * shared >= percent * (F.size("su") + F.size("sv") - shared)).select("u", "v").distinct()


def _across(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different `comp` that may be similar enough, of `sets` (id, nth, comp, s); none that is gets lost.

    Shingles are ordered by how many of these sets have them. Of two similar sets, the smaller one's first
    n - ceil(2p / (1 + p) n) + 1 shingles and the larger one's first n - ceil(p n) + 1 have one in common, and after the
    first common one there are enough left on both sides for the least overlap.
    """
    each = sets.select("id", "nth", "comp", F.size("s").alias("n"), F.explode("s").alias("t"))
    rare = each.groupBy("t").agg(F.count("*").alias("df"))
    order = each.join(rare, "t").groupBy("id", "nth").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))
    most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    few = F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1
    prefix = order.select("id", "comp", "n", few.alias("few"), F.posexplode(F.slice("o", F.lit(1), most.cast("int"))).alias("i", "e")).where("e.df > 1").select("id", "comp", "n", "few", (F.col("i") + 1).alias("i"), "e.t")
    prefix = staged(prefix, "prefixes")
    a, b = prefix.where("i <= few").alias("a"), prefix.alias("b")
    smaller = F.expr("a.n < b.n or (a.n = b.n and a.id < b.id)")
    bound = 1 + F.least(F.expr("a.n - a.i"), F.expr("b.n - b.i")) >= F.ceil((F.col("a.n") + F.col("b.n")) * percent / (100 + percent))
    on = (F.col("a.t") == F.col("b.t")) & (F.col("a.comp") != F.col("b.comp")) & smaller & (100 * F.col("a.n") >= percent * F.col("b.n")) & bound
    return a.join(b, on).select(F.greatest("a.id", "b.id").alias("u"), F.least("a.id", "b.id").alias("v")).distinct()


def near_duplicates(documents: DataFrame, words: int = WORDS, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept, uid), a row for each row of `documents` (doc_id, text).

    uid is a hash of doc_id and text.

    Null, empty and word-free texts have n_shingles 0, are linked with nothing and kept. A null doc_id is never linked:
    its class_id and component_id are null and it is kept. Rows that repeat a doc_id are judged each by its own text: with
    equal texts they share all, with different ones each has its own class; where such a row's id is its class's least one,
    it also stands for the links of the id's other texts. Other columns are ignored. An empty table gives an empty one.
    """
    docs = texts(documents).withColumn("uid", F.xxhash64("doc_id", "text"))
    sig = staged(docs.mapInArrow(released(_signatures(words, bands, rows)), "doc_id long, uid long, n_shingles long, digest binary, bands array<long>"), "signatures")
    linked = sig.where("digest is not null and doc_id is not null")
    classes = staged(linked.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")), "classes")
    keys = classes.select(F.explode("bands").alias("key"), F.col("rep").alias("id"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(keys.join(buckets, "key"), "buckets")
    shared = members.groupBy("id").agg(F.sum("n").alias("shared"))
    leads = members.join(shared, "id").groupBy("key").agg(F.min(F.struct(-F.col("shared"), "id"))["id"].alias("lead"))
    pairs = members.join(leads, "key").where("id <> lead").select(F.greatest("id", "lead").alias("u"), F.least("id", "lead").alias("v")).distinct()
    pairs = staged(pairs, "pairs")
    links = staged(_verified(pairs, _sets_of(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), classes, docs, words), percent), "links")
    found = components(links)

    placed = members.join(found, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("root", "id").alias("comp"))
    split = placed.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("key")
    rest = staged(placed.join(split, "key", "left_semi").select("id", "comp").distinct(), "open")
    sets = _sets_of(rest.select("id").distinct(), classes, docs, words).withColumn("nth", F.xxhash64("s"))
    more = staged(_across(sets.join(rest, "id"), percent).join(pairs, ["u", "v"], "left_anti"), "pairs")
    if not more.isEmpty():
        found = components(links.unionByName(_verified(more, sets, percent)))

    roots = classes.join(found, F.col("rep") == F.col("node"), "left").select("digest", "rep", F.coalesce("root", "rep").alias("root"))
    out = sig.select("doc_id", "uid", "n_shingles", "digest").join(roots, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("class_id"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"), "uid")
