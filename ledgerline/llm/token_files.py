"""Token-id files: frequency-ranked ids, 2-bit lengths in control bytes apart from 1- to 4-byte values.

A file holds blocks; a block holds whole documents: ceil(n / 4) control bytes, then the values' bytes, little-endian.
A value is the id's rank by corpus frequency (ties by id), so frequent ids take one byte. `blocks` beside the files is a
Parquet index with a row per block, and `counts` what the ranks come from. One task writes one file: the documents of one
range of doc_ids, in ascending order, so the order of the files' first ids is the order of all.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import slices, text_buffer
from .shared import file_system, released, staged, texts
from .span_cache import shared_encoder

#: More ids than this many bytes a range would hold mean more ranges than spark.sql.shuffle.partitions.
FILE_BYTES = 256 << 20
SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1  # of the four values of a control byte
_ORDER = ["doc_id", "n_tokens", "crc"]  # rows with all three equal are the same
BLOCK = "path string, file_first struct<doc_id: long, n_tokens: long, crc: long>, before long, at long, n_control long, n_bytes long, doc_ids array<long>, counts array<long>"


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, value bytes) of unsigned 32-bit values."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[: len(values)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()


def decode(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n values of encode(), by a table of sizes for each control byte."""
    size = SIZES[control].ravel()[:n]
    at = np.cumsum(size) - size
    out = data[at].astype(np.uint32)
    for b in (1, 2, 3):
        more = np.flatnonzero(size > b)
        if not len(more):
            break
        out[more] |= data[at[more] + b].astype(np.uint32) << np.uint32(8 * b)
    return out


def _tokenised(json, spans: str, end_id: int, width: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(json, spans)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                ids, at = encoder(*text_buffer(batch.column("text")), end_id)
                raw, step = ids.astype(width).tobytes(), np.dtype(width).itemsize
                offsets = pa.py_buffer((at * step).astype(np.int32).tobytes())
                body = pa.Array.from_buffers(pa.binary(), len(batch), [None, offsets, pa.py_buffer(raw)])
                view, cuts = memoryview(raw), (at * step).tolist()
                crc = pa.array([zlib.crc32(view[a:b]) for a, b in zip(cuts, cuts[1:])], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), crc, body], ["doc_id", "n_tokens", "crc", "ids"])

    return run


def _ids_of(batch: pa.RecordBatch, width: str) -> np.ndarray:
    column = batch.column("ids")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(width)


def _counted(width: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(_ids_of(batch, width), minlength=len(total))
            n[: len(total)] += total
            total = n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return run


def _written(folder: str, rank, width: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name = f"tokens-{uuid.uuid4().hex}.bin"  # a failed attempt's file has another name, which no index row knows
        out, first, before, at = None, None, 0, 0
        for whole in batches:
            for batch in slices_by_rows(whole):
                ids, counts = batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist()
                if out is None:
                    out, first = fs.open_output_stream(f"{root}/{name}"), batch.slice(0, 1).select(_ORDER).to_pylist()[0]
                control, data = encode(rank.value[_ids_of(batch, width)])
                out.write(control)
                out.write(data)
                row = {"path": f"{folder}/{name}", "file_first": first, "before": before, "at": at, "n_control": len(control), "n_bytes": len(data), "doc_ids": ids, "counts": counts}
                yield pa.RecordBatch.from_pylist([row], _SCHEMA)
                before, at = before + sum(counts), at + len(control) + len(data)
        if out is not None:
            out.close()

    return run


_LIST = pa.list_(pa.int64())
_SCHEMA = pa.schema([("path", pa.string()), ("file_first", pa.struct([(c, pa.int64()) for c in _ORDER])), ("before", pa.int64()), ("at", pa.int64()), ("n_control", pa.int64()), ("n_bytes", pa.int64()), ("doc_ids", _LIST), ("counts", _LIST)])


def slices_by_rows(batch: pa.RecordBatch, most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` tokens each."""
    to = np.cumsum(batch.column("n_tokens").to_numpy())
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(to, (to[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def write_token_files(documents: DataFrame, folder: str, tokenizer_json: str, end_id: int, vocabulary: int, spans: str = "leading") -> None:
    """Tokenise `documents` (doc_id, text) and write files, index and rank table under `folder`, a path that all executors share.

    Null texts are empty, so only end_id is written; null doc_ids come first; repeated doc_ids lie side by side. Other
    columns are ignored. An empty table gives an empty index. Texts aren't shuffled: tasks tokenise what they scan, and
    ids are dealt by ranges of doc_id. A task that runs again writes a file of its own; the index has one file of each.
    """
    spark = documents.sparkSession
    docs = texts(documents)
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    json = spark.sparkContext.broadcast(tokenizer_json)
    tokens = staged(docs.mapInArrow(released(_tokenised(json, spans, end_id, width)), "doc_id long, n_tokens long, crc long, ids binary"), "token-ids")

    counts = tokens.select("ids").mapInArrow(_counted(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts.write.parquet(f"{folder}/counts")
    _, rank, total = rank_table(spark, folder, vocabulary)
    ranks = spark.sparkContext.broadcast(rank)  # a vocabulary
    fs, root = file_system(folder)
    fs.create_dir(f"{root}/files", recursive=True)
    parts = total * np.dtype(width).itemsize // FILE_BYTES
    parts = [parts] if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    ordered = tokens.repartitionByRange(*parts, *_ORDER).sortWithinPartitions(*_ORDER)
    ordered.mapInArrow(_written(f"{folder}/files", ranks, width), BLOCK).write.parquet(f"{folder}/blocks")


def rank_table(spark: SparkSession, folder: str, vocabulary: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(id of each rank, rank of each id, number of tokens) from the counts in `folder`: at most `vocabulary` rows."""
    n = np.zeros(vocabulary, np.int64)
    for i, c in spark.read.parquet(f"{folder}/counts").collect():
        n[i] = c
    by_rank = np.lexsort((np.arange(vocabulary), -n)).astype(np.uint32)
    rank = np.empty(vocabulary, np.uint32)
    rank[by_rank] = np.arange(vocabulary, dtype=np.uint32)
    return by_rank, rank, int(n.sum())


def _read(by_rank, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = file_system(row["path"])
                with fs.open_input_file(path) as f:
                    raw = np.frombuffer(f.read_at(row["n_control"] + row["n_bytes"], row["at"]), np.uint8)
                counts = np.array(row["counts"], np.int64)
                ids = by_rank.value[decode(raw[: row["n_control"]], raw[row["n_control"] :], int(counts.sum()))].astype("<u4")
                to = np.cumsum(counts)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((to - counts).tolist(), to.tolist())]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + row["before"] + to - counts), pa.array(counts), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    offsets = pa.array(np.concatenate([[0], to]).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_token_files(spark: SparkSession, folder: str, vocabulary: int, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and ids where asked for) of every document, read from the files by byte ranges."""
    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    files = blocks.groupBy("path", "file_first").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    in_order = Window.orderBy("file_first", "path").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("path", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("base"))  # a row per file of many MB
    by_rank, _, _ = rank_table(spark, folder, vocabulary)
    tasks = spark.sparkContext.defaultParallelism * 8
    dealt = blocks.join(base, "path").repartition(tasks, "path", "at")
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return dealt.mapInArrow(_read(spark.sparkContext.broadcast(by_rank), with_ids), kind)
