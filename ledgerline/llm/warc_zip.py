"""WARC records in ZIP archives: written by Spark tasks, read back by byte ranges without extraction.

An archive has two stored members: archive/records.warc.gz with the records, each a gzip member of its own as WARC files
have them, and indexes/records.idx with a line `offset length page` per record. The reader finds the central directory from the archive's end (the ZIP64 one where
there is one), then each member's bytes, then the records' places from the index; it reads runs of whole records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import file_system, ship_code, staged

RECORDS, INDEX = "archive/records.warc.gz", "indexes/records.idx"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest(payload: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit of the record of page `refers_to`, which leaves the payload out."""
    block = _HEAD % len(payload) + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c >= " "))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    """One gzip member, the same for the same data."""
    gzip = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gzip.compress(data) + gzip.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers, HTTP head, payload) of a record's gzip member."""
    data = zlib.decompress(member, 31)
    top, _, rest = data.partition(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(head["Content-Length"])].partition(b"\r\n\r\n")
    return head, http, payload


def _id(uri: str | None) -> int | None:
    digits = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _writer(folder: str, date: str, most_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        done = []
        rows = (row for batch in batches for part in _by_rows(batch) for row in part.to_pylist())
        row = next(rows, None)
        while row is not None:
            name, index, at = f"pages-{uuid.uuid4().hex}.zip", [], 0  # a failed attempt's archives are never listed
            with fs.open_output_stream(f"{root}/{name}") as out:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
                    with archive.open(RECORDS, "w", force_zip64=True) as member:
                        while row is not None and at < most_bytes:
                            payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                            made = packed(record(row["page_id"], row["url"], payload, digest(payload), row["refers_to"], date))
                            member.write(made)
                            index.append(f"{at} {len(made)} {'' if row['page_id'] is None else row['page_id']}\n")
                            at += len(made)
                            row = next(rows, None)
                    with archive.open(INDEX, "w", force_zip64=True) as member:
                        member.write("".join(index).encode())
            done.append(f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    return run


def _by_rows(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, len(batch), rows))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", most_bytes: int = 256 << 20) -> DataFrame:
    """Write `pages` (page_id, url, html) as archives under `folder`, which all executors share; gives (path).

    Of equal payloads of at least least_bytes bytes, the page with the largest page_id is a response and the others
    revisit it. A null html is an empty payload; a page with a null page_id is a response that nothing refers to. Rows
    that repeat the largest page_id are all responses. Other columns are ignored; an empty table gives no archive.
    """
    ship_code(pages.sparkSession)
    page = F.col("page_id").cast("long").alias("page_id")
    pages = pages.select(page, F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    payload = pages.select("page_id", F.encode("html", "UTF-8").alias("b")).where(F.col("page_id").isNotNull() & (F.length("b") >= least_bytes))
    sums = staged(payload.select("page_id", F.unhex(F.sha1("b")).alias("sha1"), F.length("b").alias("n")), "payloads")
    last = sums.groupBy("sha1", "n").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    revisits = sums.join(last, ["sha1", "n"]).where("page_id < refers_to").select("page_id", "sha1", "refers_to").distinct()
    keyed = pages.withColumn("sha1", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    dealt = keyed.join(revisits, ["page_id", "sha1"], "left").select("page_id", "url", "html", "refers_to")
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    return staged(dealt.mapInArrow(_writer(folder, date, most_bytes), "path string"), "archives")


class ZipDirectory:
    """Members of a ZIP archive of `size` bytes, of which read(offset, length) reads some: name -> (data offset, size)."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        tail = read(at := max(0, size - 65_557), size - at)
        end = tail.rfind(b"PK\5\6")
        if end < 0:
            raise ValueError("no end of central directory")
        count, n_bytes, start = struct.unpack("<HII", tail[end + 10 : end + 20])
        if 0xFFFF == count or 0xFFFFFFFF in (n_bytes, start):
            locator = tail.rfind(b"PK\6\7", 0, end)
            (where,) = struct.unpack("<Q", tail[locator + 8 : locator + 16])
            count, n_bytes, start = struct.unpack("<QQQ", read(where, 56)[32:56])
        self.members: dict[str, tuple[int, int]] = {}
        raw, i = read(start, n_bytes), 0
        for _ in range(count):
            method = struct.unpack("<H", raw[i + 10 : i + 12])[0]
            packed, full, n, m, k = struct.unpack("<IIHHH", raw[i + 20 : i + 34])
            (local,) = struct.unpack("<I", raw[i + 42 : i + 46])
            name, extra = raw[i + 46 : i + 46 + n].decode(), raw[i + 46 + n : i + 46 + n + m]
            while len(extra) >= 4:
                kind, length = struct.unpack("<HH", extra[:4])
                if kind == 1:  # ZIP64: only the fields that don't fit, in this order
                    wide = list(struct.unpack(f"<{length // 8}Q", extra[4 : 4 + length // 8 * 8]))
                    full = wide.pop(0) if full == 0xFFFFFFFF else full
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    local = wide.pop(0) if local == 0xFFFFFFFF else local
                extra = extra[4 + length :]
            if method == 0:  # stored
                n_local, m_local = struct.unpack("<HH", read(local, 30)[26:30])
                self.members[name] = (local + 30 + n_local + m_local, full)
            i += 46 + n + m + k


def _runs(run_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                fs, path = file_system(uri)
                with fs.open_input_file(path) as f:
                    members = ZipDirectory(lambda at, n: f.read_at(n, at), f.size()).members
                    base = members[RECORDS][0]
                    at, size = members[INDEX]
                    places = [tuple(map(int, line.split(b" ")[:2])) for line in f.read_at(size, at).splitlines()]
                rows: list[dict] = []
                size = 0
                for offset, length in places:
                    if not rows or size + length > run_bytes:
                        rows.append({"path": uri, "at": base + offset, "lengths": []})
                        size = 0
                    size += length
                    rows[-1]["lengths"].append(length)
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("at", pa.int64()), ("lengths", pa.list_(pa.int64()))]))

    return run


_PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _read(with_payload: bool) -> Callable:
    schema = _PAGES if with_payload else _PAGES.remove(2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.to_pylist():
                fs, path = file_system(place["path"])
                with fs.open_input_file(path) as f:
                    data = f.read_at(sum(place["lengths"]), place["at"])
                rows, at = [], 0
                for length in place["lengths"]:
                    head, http, payload = parse_record(data[at : at + length])
                    at += length
                    kind, stated = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest(payload) != stated:
                        raise ValueError(f"damaged record {head['WARC-Record-ID']} in {place['path']}")
                    n = len(payload) if kind == "response" else int(http.rpartition(b"Content-Length: ")[2])
                    rows.append({"page_id": _id(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "payload": payload if with_payload and kind == "response" else None, "payload_bytes": n, "payload_digest": stated, "record_type": kind, "refers_to": _id(head.get("WARC-Refers-To"))})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(spark: SparkSession, paths: DataFrame, with_payload: bool = True, run_bytes: int = 1 << 20) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of each record of the archives in `paths` (path).

    A revisit's payload is null here; its size and digest are the full payload's. A response whose payload doesn't have
    the stated digest is an error.
    """
    ship_code(spark)
    tasks = spark.sparkContext.defaultParallelism * 4
    runs = paths.repartition(tasks, "path").mapInArrow(_runs(run_bytes), "path string, at long, lengths array<long>").repartition(tasks, "path", "at")
    kind = "page_id long, url string, " + "payload binary, " * with_payload + "payload_bytes long, payload_digest string, record_type string, refers_to long"
    return runs.mapInArrow(_read(with_payload), kind)
