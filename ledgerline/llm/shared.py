"""Tables in the cluster's shared folder, and bounded bitmaps for filtering before a join."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_path, staged  # noqa: F401  staged is used by the operators

#: Bits of a broadcast bitmap, whatever the input: 2**26 bits are 8 MB. Beyond about that many keys it only filters less.
MOST_BITS = 26
#: Bytes of rows that go to Python at once, where Spark's own bound is larger.
MOST_BATCH = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_code(spark: SparkSession) -> None:
    """Give this package to the executors' Python, unless PYTHONPATH does so already, and bound the bytes of an Arrow batch."""
    package, sc = Path(__file__).resolve().parent.parent, spark.sparkContext
    if getattr(sc, "_ledgerline_shipped", False):
        return
    sc._ledgerline_shipped = True
    if int(spark.conf.get(_BATCH).removesuffix("b")) > MOST_BATCH:
        spark.conf.set(_BATCH, MOST_BATCH)
    if str(package.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name))


def texts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key as a long and the text as a string, and no other column."""
    ship_code(documents.sparkSession)
    return documents.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which its worker gives freed memory back to the system: Spark keeps workers for later tasks, and each would hold the most that any task took."""

    def lean(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return lean


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; Hadoop deletes it when the driver ends."""
    return shared_path(spark, what)


def file_system(uri: str) -> tuple[FileSystem, str]:
    """(file system, path) of a folder that all executors share, as pyarrow writes and reads it."""
    scheme, _, rest = uri.partition("://")
    return FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def bit_of(key: Column, bits: int) -> Column:
    """Counted from 1, as bitmap_bucket_number and bitmap_bit_position do."""
    return key.bitwiseXOR(F.shiftrightunsigned(key, 32)).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(1)


def bitmap(df: DataFrame, key: str, bits: int = MOST_BITS) -> np.ndarray:
    """A bitmap of 2**bits bits over the longs in `key`, put together by Spark in pages of 4 KB, at most 2**(bits - 15) of them.

    They come in one job, as all of them are no more than the bitmap; partition by partition, each shuffle partition would be a job that waits for the one before.
    """
    pages = (
        df.select(bit_of(F.col(key), bits).alias("bit")).where("bit is not null")
        .groupBy(F.bitmap_bucket_number("bit").alias("page"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bytes"))
    )
    out = np.zeros(1 << (bits - 3), np.uint8)
    for page, part in pages.collect():
        at = (page - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(part), np.uint8)[: len(out) - at]
    return out


def in_bitmap(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which longs may be among those that the bitmap was made of; never wrong with False."""
    key = key.astype(np.int64, copy=False).view(np.uint64)
    bit = (key ^ (key >> np.uint64(32))) & np.uint64(len(bits) * 8 - 1)
    return (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def screened(df: DataFrame, *tests: tuple[Broadcast, str, bool]) -> DataFrame:
    """Rows that pass each test (broadcast bitmap, key, inside): whether the key, a long with null as 0, may be in the bitmap.

    All tests are one pass, as each Python stage of a task has a worker of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passing(batch, tests)))

    return df.mapInArrow(released(run), df.schema)


def passing(batch: pa.RecordBatch, tests: tuple[tuple[Broadcast, str, bool], ...]) -> np.ndarray:
    out = np.ones(len(batch), bool)
    for bits, key, inside in tests:
        out &= in_bitmap(bits.value, batch.column(key).fill_null(0).to_numpy()) == inside
    return out
