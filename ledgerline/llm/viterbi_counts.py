"""Token counts of a unigram vocabulary without the tokens: Aho-Corasick finds pieces, dynamic programming keeps scores and counts.

The rules are those of the tokenizers library's Unigram model behind white-space splitting and a word mark: the best sum
of scores wins; among equal sums, the path whose last piece begins first; a character that no single-character piece
covers may be unknown, at the least score less 10; neighbouring unknowns are one token.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import slices, text_buffer
from .shared import texts
from .span_cache import SpanCache, word_spans

MARK = "▁"
#: White space outside ASCII, where the library splits words too.
_WIDE_SPACE = re.compile("[\u0085   -     　]+")


def unigram_vocabulary(pieces: list[str]) -> list[tuple[str, float]]:
    """(piece, score) with the unknown piece first; the k-th piece scores -ln(k + 2), as if frequencies fell as 1 / rank."""
    return [("<unk>", 0.0), *((p, -float(np.log(k + 2))) for k, p in enumerate(dict.fromkeys(pieces)) if p and p != "<unk>")]


class Counter:
    """count(word): tokens of a word, its mark included."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.unknown = min(score for _, score in vocabulary) - 10.0
        self.pieces = ahocorasick.Automaton()
        for piece, score in vocabulary[1:]:
            self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()

    def count(self, word: str) -> int:
        size = len(word)
        best: list[float | None] = [None] * (size + 1)
        tokens, after_unknown = [0] * (size + 1), [False] * (size + 1)
        best[0], reached = 0.0, 1
        single = [False] * (size + 1)

        def unknowns(to: int) -> None:  # ends that no piece of one character reaches
            nonlocal reached
            while reached <= to:
                if not single[reached]:
                    score = best[reached - 1] + self.unknown
                    if best[reached] is None or score > best[reached]:
                        best[reached], after_unknown[reached] = score, True
                        tokens[reached] = tokens[reached - 1] + (not after_unknown[reached - 1])
                reached += 1

        for end, (length, score) in self.pieces.iter(word):  # at each end, the longest piece first
            unknowns(end)
            end += 1
            start = end - length
            score += best[start]
            if length == 1:
                single[end] = True
            if best[end] is None or score > best[end]:
                best[end], after_unknown[end], tokens[end] = score, False, tokens[start] + 1
        unknowns(size)
        return tokens[size]

    def count_text(self, word: str) -> int:
        return sum(self.count(MARK + w) for w in _WIDE_SPACE.split(word) if w)


@lru_cache(maxsize=2)
def _cached(vocabulary: str) -> SpanCache:
    counter = Counter([tuple(x) for x in json.loads(vocabulary)])
    return SpanCache(lambda spans: [np.array([counter.count_text(s.decode())], np.uint32) for s in spans])


def _counts(vocabulary) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cached(vocabulary.value)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                data, offsets = text_buffer(batch.column("text"))
                spans, first = word_spans(data, offsets)
                values, _ = cache.look_up(spans)
                to = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[first]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first)), pa.array(np.diff(to))], ["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(documents: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """(doc_id, n_words, n_tokens), a row for each row of `documents` (doc_id, text), with words between ASCII white space.

    Null, empty and blank texts have no words and no tokens. Null and repeated doc_ids are counted like any other row;
    other columns are ignored; an empty table gives an empty one.
    """
    docs = texts(documents)
    shared = documents.sparkSession.sparkContext.broadcast(json.dumps(vocabulary))  # a tokenizer's vocabulary
    return docs.mapInArrow(_counts(shared), "doc_id long, n_words long, n_tokens long")
