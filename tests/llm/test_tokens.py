"""Token files, packing and counts against the tokenizers library."""

import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from ledgerline.llm.inputs import pieces, tokenizer
from ledgerline.llm import packing
from ledgerline.llm.packing import best_fit, pack
from ledgerline.llm.shared import fresh_path
from ledgerline.llm.span_cache import text_encoder
from ledgerline.llm.token_files import decode, encode, read_token_files, write_token_files
from ledgerline.llm.viterbi_counts import Counter, token_counts, unigram_vocabulary

TEXTS = [
    (5, "Hello  world\n\n it's  DON'T  \tx "), (1, ""), (2, None), (3, "a  b　c  é é́ <|endoftext|> ok"), (9, "word " * 3000), (4, "日本語のテキスト。" * 40),
    (7, "\n\n\n"), (None, "no id"), (8, "repeat"), (8, "repeat"), (6, "x" * 5000),
]
SCHEMA = "doc_id long, text string, start string, n_tokens string, piece string, length string"


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], SCHEMA)


def library(name):
    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.encode_special_tokens = True
    return found


def crc(ids, kind="<u4"):
    return zlib.crc32(np.array(ids, kind).tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1)))
def test_values_round_trip(values):
    control, data = encode(np.array(values, np.uint32))
    assert decode(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(values)).tolist() == values


def test_files_give_back_what_the_library_encodes(spark):
    json, vocabulary = tokenizer("byte_bpe_50k.json")
    folder = fresh_path(spark, "t")
    write_token_files(frame(spark), folder, json, 0, vocabulary)
    got = sorted(read_token_files(spark, folder, vocabulary).collect(), key=lambda r: r.start)
    tok, start = library("byte_bpe_50k.json"), 0
    for row, (i, text) in zip(got, sorted(TEXTS, key=lambda x: (x[0] is not None, x[0])), strict=True):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32, row.ids) == (i, start, len(ids), crc(ids), ids)
        start += len(ids)
    empty = fresh_path(spark, "t")
    write_token_files(frame(spark, []), empty, json, 0, vocabulary)
    assert read_token_files(spark, empty, vocabulary).count() == 0


def test_starts_hold_over_many_partitions(spark):
    """24 ranges, none of them put together again, and ids that a task meets out of order."""
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "it's"]) for _ in range(rng.randrange(40)))) for i in rng.sample(range(5000), 900)]
    texts += [(None, "x"), (77_000, None), (77_000, "one"), (77_000, "two words"), (77_000, "one")]
    json, vocabulary = tokenizer("byte_bpe_50k.json")
    tok = library("byte_bpe_50k.json")
    with_ids = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in texts]
    want, start = [], 0
    for i, ids in sorted(with_ids, key=lambda x: (x[0] is not None, x[0], len(x[1]), crc(np.array(x[1], "<u2"), "<u2"))):
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    for coalesce, size in (("false", "64m"), ("true", "1k")):
        old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.maxPartitionBytes")}
        try:
            for k, v in zip(old, ("24", coalesce, size)):
                spark.conf.set(k, v)
            folder = fresh_path(spark, "t")
            write_token_files(frame(spark, texts).repartition(24), folder, json, 0, vocabulary)
            got = read_token_files(spark, folder, vocabulary, with_ids=False).collect()
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)
        assert sorted([tuple(r) for r in got], key=lambda r: r[1]) == want


TWIN = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
OTHER = TWIN.translate(str.maketrans("ab", "ba"))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([TWIN, OTHER, " " + TWIN, "it's", " <|endoftext|>", "\n\n", " \x01 ", "é ", "日本", "word", " word", "  "]), max_size=12))
def test_spans_are_told_apart_by_their_bytes(parts):
    text = "".join(parts)
    for name, spans in (("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "words")):
        data = np.frombuffer(text.encode(), np.uint8)
        ids, at = text_encoder(tokenizer(name)[0], spans)(data, np.array([0, len(data)]), 7)
        assert ids.tolist() == [*library(name).encode(text, add_special_tokens=False).ids, 7]


def test_counts_of_words_that_weak_hashes_confuse(spark):
    vocabulary = unigram_vocabulary(["▁", "a", "b", "ab", "abba", "baab" * 2])
    tok = unigram(vocabulary)
    got = {r.doc_id: r.n_tokens for r in token_counts(frame(spark, [(1, TWIN), (2, OTHER), (3, f"{TWIN} {OTHER}")]), vocabulary).collect()}
    assert got == {1: len(tok.encode(TWIN).ids), 2: len(tok.encode(OTHER).ids), 3: len(tok.encode(f"{TWIN} {OTHER}").ids)}


def test_a_length_of_many_parts_is_packed_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 7)
    got = pack(frame(spark, [(i % 90, "same words here") for i in range(200)] + [(500 + i, "word " * i) for i in range(60)]).repartition(8), tokenizer("word_bpe_49k.json")[0], 1, capacity=32).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    at = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 32


def test_pieces_are_whole_and_sequences_gapless(spark):
    got = pack(frame(spark), tokenizer("word_bpe_49k.json")[0], 1, capacity=64).collect()
    tok, want = library("word_bpe_49k.json"), []
    for i, text in TEXTS:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(str(i), at // 64, at, len(ids[at : at + 64]), crc(ids[at : at + 64])) for at in range(0, len(ids), 64)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    at = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 64
    assert pack(frame(spark, []), tokenizer("word_bpe_49k.json")[0], 1).count() == 0


def test_runs_equal_best_fit_decreasing_piece_by_piece():
    rng = random.Random(4)
    for capacity in (10, 64, 1000):
        sizes = [rng.randint(1, capacity) for _ in range(400)] + [capacity // 3] * 100
        rooms, bins = [], 0
        for size in sorted(sizes, reverse=True):
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                bins += 1
                bisect.insort(rooms, capacity - size)
            else:
                bisect.insort(rooms, rooms.pop(at) - size)
        plan = best_fit({s: sizes.count(s) for s in set(sizes)}, capacity)
        used = {first + k // per for _, a, b, per, first, _ in plan for k in range(b - a)}
        assert len(used) == bins
        assert sum(b - a for _, a, b, *_ in plan) == len(sizes)


def unigram(vocabulary):
    tok = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
    return tok


TIES = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("ba", -2.0), ("aba", -3.0), ("é", -1.5)]


@settings(max_examples=300, deadline=None)
@given(st.text("abé漢x", max_size=12))
def test_counts_follow_the_library_in_ties_and_unknowns(word):
    assert Counter(TIES).count_text(word) == len(unigram(TIES).encode(word).ids)


def test_counts_of_texts(spark):
    vocabulary = unigram_vocabulary(pieces("piece_bpe_32k.model"))
    tok = unigram(vocabulary)
    got = token_counts(frame(spark), vocabulary).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in got) == sorted((str(i), len((t or "").replace(" ", "_").replace("　", "_").split()), len(tok.encode(t or "").ids)) for i, t in TEXTS)
    assert token_counts(frame(spark, []), vocabulary).count() == 0


def test_workers_give_back_what_packing_took(spark):
    """Spark keeps workers for later tasks: what the encoder and freed arrays hold must not stay in them."""
    docs = spark.range(8, numPartitions=4).selectExpr("id doc_id", "concat_ws(' ', transform(sequence(1, 150000), x -> concat('w', (x * 7919 + id * 104729) % 400009))) text")
    pack(docs, tokenizer("word_bpe_49k.json")[0], 1).count()
    other = spark.sparkContext.broadcast(0)  # the next task has other broadcasts

    def held(batches):
        import gc
        from pathlib import Path

        from ledgerline.llm import span_cache

        for batch in batches:
            gc.collect()
            mb = sum(int(x.split()[1]) for x in Path("/proc/self/smaps_rollup").read_text().splitlines() if x.startswith("Private_Dirty")) >> 10
            yield pa.RecordBatch.from_arrays([pa.array([mb]), pa.array([other.value + len(span_cache._ENCODERS)])], ["mb", "encoders"])

    found = spark.range(4, numPartitions=4).mapInArrow(held, "mb long, encoders long").collect()
    assert all(r.encoders == 0 for r in found)
    assert max(r.mb for r in found) < 200
