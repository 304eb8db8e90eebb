"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are lower-cased words and beginnings of longer words, so that unseen forms of a word still meet its kin. Every term
of the labelled examples, of both classes, is in the index; its smoothed IDF is multiplied by how far it goes with the
label, which has no threshold: a term that says nothing keeps a small weight. The examples lie in blocks; the index keeps
for each term its postings and the largest weight in each block, and blocks whose bound can't reach the k-th best are
never opened.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, LOWER, ODD, Words, mix, slices, span_hashes, text_buffer
from .shared import released, texts

#: Bounds of the fit: labelled examples of each class, and terms. 2 x 2000 texts of usual length have about 220,000 terms, so
#: the second one only holds if examples are very long; then the terms with the largest weights stay.
EXAMPLES, TERMS = 2000, 1 << 20
HEADS, LONG = (4, 5), 7  # bytes of a word's beginning that are terms too, of words of at least LONG bytes
NEIGHBOURS, BLOCK = 15, 64
_POSTING = np.dtype([("place", "<i4"), ("value", "<f4")])


def term_hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(term, text) of every term occurrence."""
    data, offsets = text_buffer(batch.column("text"))
    data = LOWER[data]
    words = Words(data, offsets, ALNUM)
    owner = np.repeat(np.arange(len(batch)), words.count)
    long = np.flatnonzero(words.end - words.start >= LONG)
    heads = [mix(span_hashes(data, words.start[long], words.start[long] + n) + ODD[n]) for n in HEADS]
    return np.concatenate([span_hashes(data, words.start, words.end), *heads]), np.concatenate([owner, *(owner[long] for _ in HEADS)])


@dataclass
class Model:
    terms: np.ndarray  # sorted hashes
    idf: np.ndarray  # times the association with the label
    example: np.ndarray  # doc_id of each example, block by block
    toxic: np.ndarray
    weight: np.ndarray  # of an example's vote
    first: np.ndarray  # the entries of term t, one for each block with postings of it, are first[t]:first[t + 1]
    block: np.ndarray  # of each entry
    start: np.ndarray  # the postings of entry e are start[e]:start[e + 1]
    best: np.ndarray  # largest value of each entry
    doc: np.ndarray  # postings: place of the example in its block
    value: np.ndarray
    empty_score: float
    prior: float

    @property
    def blocks(self) -> int:
        return -(-len(self.example) // BLOCK)

    @cached_property
    def cut(self) -> np.ndarray:
        """[term, block], dense: where the postings of a term in a block begin; the next block's place ends them."""
        key = np.repeat(np.arange(len(self.terms)), np.diff(self.first)) * self.blocks + self.block
        at = np.arange(len(self.terms))[:, None] * self.blocks + np.arange(self.blocks + 1)
        return self.start[np.searchsorted(key, at)]

    @cached_property
    def most(self) -> np.ndarray:
        """[term, block], dense: largest value."""
        out = np.zeros((len(self.terms), self.blocks), self.best.dtype)
        out[np.repeat(np.arange(len(self.terms)), np.diff(self.first)), self.block] = self.best
        return out

    def vectors(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term number, weight) triples of unit vectors, by text and term."""
        term, owner = term_hashes(batch)
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at = np.searchsorted(self.terms, term)
        known = self.terms[np.minimum(at, len(self.terms) - 1)] == term
        key, n = np.unique(owner[known] * len(self.terms) + at[known], return_counts=True)
        text, at = np.divmod(key, len(self.terms))
        value = (1 + np.log(n)) * self.idf[at]
        norm = np.sqrt(np.bincount(text, value**2, len(batch)))
        return text, at, value / norm[text]

    @cached_property
    def place(self) -> np.ndarray:
        """Of each posting, the example's place among all."""
        return np.repeat(self.block, np.diff(self.start)).astype(np.int64) * BLOCK + self.doc

    @cached_property
    def posting(self) -> np.ndarray:
        """(place, value) of each posting side by side in 8 bytes."""
        out = np.empty(len(self.value), _POSTING)
        out["place"], out["value"] = self.place, self.value
        return out.view(np.int64)

    def nearest(self, at: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k examples nearest to a unit vector, best first, ties by place; only cosines over 0.

        The two blocks with the largest bounds are opened first, then those whose bound reaches the k-th best so far. Where
        bounds are even, or most blocks' reach it, all postings of the terms are read, which lie together.
        """
        first, last = self.first[at], self.first[at + 1]
        own, entry = _ranges(first, last)
        block = self.block[entry]
        bound = np.bincount(block, value[own] * self.best[entry], self.blocks)
        order = np.argsort(-bound, kind="stable")[: int(np.count_nonzero(bound > 0))]
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        if len(order) and 2 * bound[order[len(order) // 2]] < bound[order[0]]:
            places, scores = _top(self._open(order[:2], own, entry, block, value), places, scores, k)
            least = scores[-1] - 1e-6 if len(scores) == k else 0.0
            order = order[2:][bound[order[2:]] >= least]
            if 2 * len(order) <= self.blocks:
                return _top(self._open(order, own, entry, block, value), places, scores, k) if len(order) else (places, scores)
        return _top(self._all(first, last, value), places[:0], scores[:0], k) if len(order) else (places, scores)

    def _all(self, first: np.ndarray, last: np.ndarray, value: np.ndarray, few: int = 32) -> np.ndarray:
        """Cosines of all examples, by place; the many terms with few postings are gathered, the others' postings sliced."""
        start, end = self.start[first], self.start[last]
        small = np.flatnonzero(end - start <= few)
        large = np.flatnonzero(end - start > few)
        own, at = _ranges(start[small], end[small])
        parts = [self.posting[at], *(self.posting[a:b] for a, b in zip(start[large].tolist(), end[large].tolist()))]
        found = np.concatenate(parts).view(_POSTING)
        weight = np.concatenate([value[small][own], np.repeat(value[large], end[large] - start[large])])
        return np.bincount(found["place"], weight * found["value"])

    def _open(self, blocks: np.ndarray, own: np.ndarray, entry: np.ndarray, block: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Cosines of the examples in some blocks, by place."""
        wanted = np.zeros(self.blocks, bool)
        wanted[blocks] = True
        pick = np.flatnonzero(wanted[block])
        of, posting = _ranges(self.start[entry[pick]], self.start[entry[pick] + 1])
        return np.bincount(self.place[posting], value[own[pick]][of] * self.value[posting])

    def score(self, places: np.ndarray, cosines: np.ndarray) -> float:
        vote = self.weight[places] / (1.05 - np.minimum(cosines, 1.0)) * cosines**3
        return float((vote @ self.toxic[places] + 0.05 * self.prior) / (vote.sum() + 0.05))


def _top(cosine: np.ndarray, places: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of cosines by place and of (places, scores), best first, ties by place; only cosines over 0."""
    hit = np.flatnonzero(cosine)
    if len(hit) > k:
        hit = hit[cosine[hit] >= np.partition(cosine[hit], -k)[-k] - 1e-8]
    places, scores = np.concatenate([places, hit]), np.concatenate([scores, cosine[hit]])
    best = np.lexsort((places, -np.round(scores, 9)))[:k]
    return places[best], scores[best]


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, value) of all values in the ranges start[i]:end[i]."""
    size = (end - start).astype(np.int64)
    own = np.repeat(np.arange(len(size)), size)
    return own, np.arange(len(own)) + np.repeat(start - (np.cumsum(size) - size), size)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            term, owner = term_hashes(batch)
            order = np.lexsort((term, owner))
            term, owner = term[order], owner[order]
            new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (owner[1:] != owner[:-1]))) if len(term) else np.zeros(0, np.int64)
            n = np.diff(np.append(new, len(term)))
            cut = pa.array(np.searchsorted(owner[new], np.arange(len(batch) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.ListArray.from_arrays(cut, pa.array(term[new].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(n.astype(np.int32)))], ["doc_id", "toxic", "terms", "counts"]
            )


def association(df: np.ndarray, p: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """How far terms in df of n texts, p of them toxic, go with the label: 0.1 and up, smooth in all counts."""
    rate = n_toxic / max(n, 1)
    z = (p - df * rate) / np.sqrt(df * rate * (1 - rate) + 1)
    return 0.1 + (z * (2 * p / df - 1)) ** 2


def fit(documents: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int = TERMS) -> Model:
    """Fit on up to `examples` labelled texts of each class, by the order of their ids' hash, and up to `terms` terms.

    Only labels whose crc32(doc_id as text) mod 3 isn't 1 are used. Null labels and ids are left out; of repeated labels
    the larger counts, of repeated documents one. With no examples every score is the prior 0.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(fold).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {int(r.toxic): r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for y in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * examples ids
    rows = texts(documents).join(sample, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "toxic", "text")
    rows = rows.mapInArrow(released(_counted), "doc_id long, toxic int, terms array<long>, counts array<int>").toArrow().combine_chunks()  # of at most 2 * examples texts
    ids, label = rows["doc_id"].to_numpy(), rows["toxic"].to_numpy()
    order = np.argsort(ids)
    size = pc.list_value_length(rows["terms"]).to_numpy()
    row = np.repeat(np.argsort(order), size)
    term = pc.list_flatten(rows["terms"]).to_numpy().view(np.uint64)
    count = pc.list_flatten(rows["counts"]).to_numpy()
    ids, label = ids[order], label[order]

    vocabulary, at, df = np.unique(term, return_inverse=True, return_counts=True)
    p = np.bincount(at, label[row], len(vocabulary))
    idf = (np.log((1 + len(ids)) / (1 + df)) + 1) * association(df, p, len(ids), int(label.sum()))
    if len(vocabulary) > terms:
        stay = np.sort(np.argsort(-idf, kind="stable")[:terms])
        new = np.full(len(vocabulary), -1)
        new[stay] = np.arange(terms)
        inside = new[at] >= 0
        vocabulary, idf, at, row, count = vocabulary[stay], idf[stay], new[at][inside], row[inside], count[inside]
    prior = total.get(1, 0) / max(1, sum(total.values()))
    return _indexed(vocabulary, idf, dict(zip(ids.tolist(), label.tolist())), at, ids[row], count, total, prior)


def _index(vocabulary: np.ndarray, idf: np.ndarray, toxic: dict[int, int], triples: list, total: dict[int, int], prior: float) -> Model:
    """The index of examples given as rows of doc_id, term and n."""
    at = np.searchsorted(vocabulary, np.array([t.term for t in triples], np.int64).view(np.uint64)) if triples else np.zeros(0, np.int64)
    return _indexed(vocabulary, idf, toxic, at, np.array([t.doc_id for t in triples], np.int64), np.array([t.n for t in triples], np.int64), total, prior)


def _indexed(vocabulary: np.ndarray, idf: np.ndarray, toxic: dict[int, int], at: np.ndarray, ids: np.ndarray, n: np.ndarray, total: dict[int, int], prior: float) -> Model:
    """The block-max index of the examples that have terms; like examples lie together, by their weightiest term."""
    value = (1 + np.log(n)) * idf[at]
    people, owner = np.unique(ids, return_inverse=True)
    value /= np.sqrt(np.bincount(owner, value**2, len(people)))[owner]
    top = np.full(len(people), -1)
    by = np.lexsort((at, value))
    top[owner[by]] = at[by]  # the last, weightiest one stays
    place = np.empty(len(people), np.int64)
    arranged = np.lexsort((people, top))
    place[arranged] = np.arange(len(people))
    owner, people = place[owner], people[arranged]
    blocks = -(-len(people) // BLOCK)
    key = at * blocks + owner // BLOCK
    order = np.lexsort((owner, key))
    key, value, owner = key[order], value[order].astype(np.float32), owner[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    first = np.searchsorted(key[new], np.arange(len(vocabulary) + 1) * blocks).astype(np.int32)
    best = np.maximum.reduceat(value, new) if len(new) else value
    label = np.array([toxic[i] for i in people.tolist()], float)
    drawn = {y: max(1, sum(1 for v in toxic.values() if v == y)) for y in (0, 1)}
    share = {y: total.get(y, 0) / drawn[y] for y in (0, 1)}
    weight = np.where(label == 1, share[1], share[0]) / max(share.values(), default=1) if len(people) else np.zeros(0)
    empty = set(toxic) - set(people.tolist())
    mass = [sum(share[y] for i in empty if toxic[i] == y) for y in (0, 1)]
    block = (key[new] % max(blocks, 1)).astype(np.int32)
    start = np.append(new, len(key)).astype(np.int32)
    return Model(vocabulary, idf, people, label, weight, first, block, start, best, (owner % BLOCK).astype(np.int16), value, (mass[1] + prior) / (sum(mass) + 1), prior)


_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))


def _scored(shared, k: int, evidence: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for whole in batches:
            for batch in slices(whole, "text"):
                scores, proof = np.full(len(batch), model.empty_score), [[] for _ in range(len(batch))]
                text, at, value = model.vectors(batch)
                edges = np.flatnonzero(np.append(True, text[1:] != text[:-1])).tolist() if len(text) else []
                for a, b in zip(edges, [*edges[1:], len(text)]):
                    key = blake2b(at[a:b].tobytes() + value[a:b].round(9).tobytes(), digest_size=16).digest()
                    if key not in known:
                        if len(known) > 4096:
                            known.clear()
                        places, cosines = model.nearest(at[a:b], value[a:b], k)
                        near = [{"doc_id": int(model.example[p]), "cosine": float(c), "toxic": int(model.toxic[p])} for p, c in zip(places[:evidence], cosines)]
                        known[key] = (model.score(places, cosines) if len(places) else model.empty_score, near)
                    scores[text[a]], proof[text[a]] = known[key]
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), batch.column("text"), pa.array(scores), pa.array(proof, _EVIDENCE)], [*names, "text", "score", "evidence"])

    return run


def score(documents: DataFrame, model: Model, neighbours: int = NEIGHBOURS, evidence: int = 3) -> DataFrame:
    """(doc_id, text, score, evidence), a row for each row of `documents` (doc_id, text).

    The score in 0..1 rises with toxicity. Null and empty texts, and texts with no term of the vocabulary, get the share
    of toxic ones among such examples. Evidence lists the nearest examples. Null and repeated doc_ids are scored like any
    other row; other columns are ignored; an empty table gives an empty one.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the fit's numbers of examples and terms
    kind = "doc_id long, text string, score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>"
    return texts(documents).mapInArrow(released(_scored(shared, neighbours, evidence)), kind)


def reliability(scored: DataFrame, labels: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, toxic_share) over labelled rows that fit() leaves out: how far scores are the share of toxic texts.

    `scored` has doc_id and score, `labels` doc_id and toxic; nulls are left out. A bin without rows has none here.
    """
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    known = labels.where(held & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    rows = scored.select("doc_id", "score").join(known, "doc_id")
    return rows.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("toxic").alias("toxic_share")).orderBy("bin")
