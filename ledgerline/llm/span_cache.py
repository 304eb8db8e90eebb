"""Encode each distinct span of a stream of texts once per Python worker, and gather the results with numpy.

A tokenizer that never lets a token cross certain byte boundaries gives for a whole text just what it gives for the
spans between them, one after another. Invented and natural prose repeat their words, so most spans are looked up.
Spans are told apart by their bytes: Arrow numbers the distinct ones of a batch, and a dictionary knows those of earlier
batches. A cache that reaches its bound keeps what the batch at hand has met again; a worker's memory stays bounded, and
what is forgotten costs time but no result.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from tokenizers import Tokenizer

from .arrays import NOT_SPACE, SPACE, Words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
_SEPARATOR, _AT_ONCE = "\x01", 256
_ASCII = np.arange(256) < 128
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True

#: Bounds of a cache: spans, bytes of spans, values. Longer spans than LONGEST are encoded whenever they occur.
MOST_SPANS, MOST_BYTES, MOST_VALUES, LONGEST = 500_000, 16 << 20, 4_000_000, 256


class SpanCache:
    """encode(list of span bytes) gives an array of values for each; here they are kept in one flat array that doubles."""

    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray]], dtype=np.uint32):
        self.encode = encode
        self.values, self.first = np.zeros(1 << 12, dtype), np.zeros(1 << 12, np.int64)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.n_bytes = self.n_values = 0
        self.first[0] = 0

    def _add(self, spans: list[bytes], got: list[np.ndarray]) -> None:
        at, new = len(self.known), sum(map(len, got))
        while self.n_values + new > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while at + len(spans) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        if new:
            self.values[self.n_values : self.n_values + new] = np.concatenate(got)
        self.first[at + 1 : at + 1 + len(spans)] = self.n_values + np.cumsum([len(x) for x in got])
        self.known.update(zip(spans, range(at, at + len(spans))))
        self.n_values, self.n_bytes = self.n_values + new, self.n_bytes + sum(map(len, spans))

    def look_up(self, spans: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all spans end to end, how many each span has)."""
        if not len(spans):
            return self.values[:0], np.zeros(0, np.int64)
        numbered = spans.dictionary_encode()
        distinct = _bytes(numbered.dictionary)
        if len(self.known) + len(distinct) > MOST_SPANS or self.n_bytes > MOST_BYTES or self.n_values > MOST_VALUES:
            again = [(s, self.known[s]) for s in distinct if s in self.known]
            kept = [self.values[self.first[i] : self.first[i + 1]].copy() for _, i in again]
            self.clear()
            self._add([s for s, _ in again], kept)
        number = np.array([self.known.get(s, -1) for s in distinct], np.int64)
        new = np.flatnonzero(number < 0)
        extra: list[np.ndarray] = []
        if len(new):
            texts = [distinct[i] for i in new.tolist()]
            got = self.encode(texts)
            short = np.array([len(t) <= LONGEST for t in texts])
            number[new[short]] = len(self.known) + np.arange(int(short.sum()))
            self._add([t for t, s in zip(texts, short) if s], [x for x, s in zip(got, short) if s])
            extra = [x for x, s in zip(got, short) if not s]
        first, size, values = self.first[number], self.first[number + 1] - self.first[number], self.values
        if extra:
            long = new[~short]
            size[long] = [len(x) for x in extra]
            first[long] = self.n_values + np.cumsum(size[long]) - size[long]
            values = np.concatenate([self.values[: self.n_values], *extra])
        at = numbered.indices.to_numpy()
        first, size = first[at], size[at]
        to = np.cumsum(size)
        return values[np.repeat(first - to + size, size) + np.arange(int(to[-1]))], size


def leading_space_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """Spans that cover whole texts: (spans, first span of each text).

    They are cut where white space follows another ASCII byte, and where another ASCII byte follows an ASCII letter: the
    byte-level patterns keep letters by themselves, but for an apostrophe's suffix, which ends with its letters too.
    """
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = SPACE[data[1:]] & (NOT_SPACE & _ASCII)[data[:-1]] | (_ASCII & ~_LETTER)[data[1:]] & _LETTER[data[:-1]]
    cut[offsets] = True
    at = np.flatnonzero(cut)
    return _binary(data, at), np.searchsorted(at, offsets)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """Runs of bytes that aren't ASCII white space: (spans, first span of each text)."""
    words = Words(data, offsets, NOT_SPACE)
    edges = np.empty(2 * len(words.start), np.int64)
    edges[::2], edges[1::2] = words.start, words.end
    spans = _binary(data, edges)
    return spans.take(pa.array(np.arange(0, len(spans), 2))) if len(spans) else spans, words.first


def _bytes(spans: pa.BinaryArray) -> list[bytes]:
    """What to_pylist gives, several times as fast."""
    _, off, data = spans.buffers()
    at = np.frombuffer(off, np.int32, len(spans) + 1, spans.offset * 4).tolist()
    raw = memoryview(data) if data is not None else b""
    return [bytes(raw[a:b]) for a, b in zip(at, at[1:])]


def _binary(data: np.ndarray, edges: np.ndarray) -> pa.BinaryArray:
    """The bytes between each edge and the next."""
    if len(edges) < 2:
        return pa.array([], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])


class TextEncoder:
    """Token ids of whole texts by the tokenizers library.

    spans="leading" suits byte-level vocabularies without a normalizer, whose patterns take white space with the word
    after it; spans="words" suits those that drop white space. Special tokens' strings in a text are ordinary text.
    """

    def __init__(self, json: str, spans: str):
        self.tokenizer = Tokenizer.from_str(json)
        self.tokenizer.encode_special_tokens = True
        self.spans = leading_space_spans if spans == "leading" else word_spans
        if spans == "leading":
            vocabulary = self.tokenizer.get_vocab()
            self.width = np.zeros(1 + max(vocabulary.values()), np.int64)  # bytes of each id: a character of its name stands for one
            self.width[list(vocabulary.values())] = [len(name) for name in vocabulary]
            self.merged = self.tokenizer.model.tokenize  # of what the pattern leaves whole, with Ġ for a space
            self.plain = all([t.id for t in self.merged("Ġ" + w)] == self._ids(" " + w).tolist() for w in ("a", "word", "Zqxj", "internationalisation"))
        else:
            alone, between = self._ids(_SEPARATOR), self._ids(f"a {_SEPARATOR} a")
            self.separator = int(alone[0]) if len(alone) == 1 and (between == [*self._ids("a"), *alone, *self._ids("a")]).all() else None
        self.cache = SpanCache(self._led if spans == "leading" else self._separate)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _led(self, spans: list[bytes]) -> list[np.ndarray]:
        """Spans from white space to another ASCII byte make up texts like those that they were cut from, many to a call; the ids' bytes tell them apart."""
        joined = lambda s: s and SPACE[s[0]] and s[-1] < 128 and not SPACE[s[-1]]
        word = [self.plain and s[:1] == b" " and s[1:].isalpha() for s in spans]  # a space and ASCII letters: one piece of the pattern
        ids = iter(self._cut_up([s for s, w in zip(spans, word) if not w], joined))
        return [np.array([t.id for t in self.merged("Ġ" + s[1:].decode())], np.uint32) if w else next(ids) for s, w in zip(spans, word)]

    def _cut_up(self, spans: list[bytes], joined: Callable) -> list[np.ndarray]:
        return self._many(spans, joined, "", lambda ids, part: np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(s) for s in part[:-1]]), "right"), 0)

    def _separate(self, spans: list[bytes]) -> list[np.ndarray]:
        """Words, many to a call with a word between them that has one id and is in none of them."""
        joined = lambda s: self.separator is not None and _SEPARATOR.encode() not in s
        return self._many(spans, joined, f" {_SEPARATOR} ", lambda ids, part: np.flatnonzero(ids == self.separator), 1)

    def _many(self, spans: list[bytes], joined: Callable, between: str, cuts: Callable, skip: int) -> list[np.ndarray]:
        """Ids of each span; those that `joined` allows are encoded `_AT_ONCE` to a call, where `cuts` finds them again."""
        out: list[np.ndarray] = [None] * len(spans)  # type: ignore[list-item]
        together = [i for i, s in enumerate(spans) if joined(s)]
        parts = [together[at : at + _AT_ONCE] for at in range(0, len(together), _AT_ONCE)]
        texts = [between.join([spans[i].decode() for i in part]) for part in parts]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            at = cuts(ids, [spans[i] for i in part]).tolist()
            for i, a, b in zip(part, [0, *(x + skip for x in at)], [*at, len(ids)], strict=True):
                out[i] = ids[a:b]
        alone = [i for i, ids in enumerate(out) if ids is None]
        for i, found in zip(alone, self.tokenizer.encode_batch_fast([spans[i].decode() for i in alone], add_special_tokens=False)):
            out[i] = np.array(found.ids, np.uint32)
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with end_id after it, end to end; where each text's begin, with the total last)."""
        spans, first = self.spans(data, offsets)
        ids, size = self.cache.look_up(spans)
        to = np.concatenate([[0], np.cumsum(size)])[first]
        return np.insert(ids, to[1:], np.uint32(end_id)), to + np.arange(len(to))


@lru_cache(maxsize=2)
def text_encoder(json: str, spans: str) -> TextEncoder:
    """An encoder that is kept for later calls."""
    return TextEncoder(json, spans)


_ENCODERS: WeakKeyDictionary[Broadcast, TextEncoder] = WeakKeyDictionary()


def shared_encoder(json: Broadcast, spans: str) -> TextEncoder:
    """A worker's encoder, kept for its later tasks with that broadcast; it goes when the worker's next task has other broadcasts."""
    if json not in _ENCODERS:
        _ENCODERS[json] = TextEncoder(json.value, spans)
    return _ENCODERS[json]
