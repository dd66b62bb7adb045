"""WARC archives in seekable Zstandard bundles, with an index of their records.

A bundle is a file of independent Zstandard frames, each of some whole records, and a seek table at its end
in a skippable frame: the sizes of all frames, so that one is reached without the others.  The index
maps a record's identifier to its bundle, its frame, and offset and length inside the frame; a reader without
the index decompresses a bundle frame by frame.  Any Zstandard tool can decompress a bundle whole.

Records with equal payloads of at least `least_bytes` are stored once: that of the smallest page_id is a
response, the others are revisits that name it and hold the HTTP header alone, whose Content-Length and
payload digest are those of the full payload.  Payloads meet by their SHA-256; a payload that a large part of
all pages share is broadcast with its few like, so its pages don't meet in one task.

Each task writes bundles of its own, under names that no other attempt uses, into the folder, and the index
that Spark commits names only those of attempts that succeeded.  A task holds a frame and a record at a time.

Defined results: a null html is an empty payload; a null url leaves its header out; control characters of
a url are percent-encoded; rows with the page_id that others refer to are responses all; rows without a page_id come
last, refer to the others, and are responses where none has one; a payload of any length is one record, in a
frame of its own if longer than a frame; columns besides page_id, url and html are not read; an empty table
gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, cut, ensure_checkpoint_dir, joined, table

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 256 << 20, 3
#: Fixed values of the seekable format: of a skippable frame, and of the seek table's last bytes.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, page_id long, path string, frame long, offset long, length long"
RECORD = "record_id string, page_id long, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder that all tasks reach, and the path in it."""
    if re.match("file:/|/", uri):
        return pyarrow.fs.LocalFileSystem(), re.sub("^file:/+", "/", uri)
    return pyarrow.fs.FileSystem.from_uri(uri)


def sha1_32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    at = record.removeprefix("<urn:page:").removesuffix(">")
    return None if at == "none" else int(at)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A whole WARC record; a revisit if it refers to another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    head += [f"WARC-Payload-Digest: sha1:{sha1_32(payload)}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parsed(data: bytes, start: int = 0) -> tuple[dict, int]:
    """The record at `start` of a decompressed frame (columns of RECORD), and where the next one begins."""
    split = data.index(b"\r\n\r\n", start)
    f = _fields(data[start:split])
    begin, end = split + 4, split + 4 + int(f["Content-Length"])
    http = data.index(b"\r\n\r\n", begin, end)
    payload = data[http + 4 : end]
    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(_fields(data[begin:http])["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n" or f["WARC-Type"] == "response" and (len(payload) != size or sha1_32(payload) != digest):
        raise ValueError(f"record {f['WARC-Record-ID']} is damaged")
    of = f.get("WARC-Refers-To")
    return {
        "record_id": f["WARC-Record-ID"], "page_id": page_of(f["WARC-Record-ID"]), "record_type": f["WARC-Type"], "url": f.get("WARC-Target-URI"),
        "payload": payload if f["WARC-Type"] == "response" else None, "payload_bytes": size, "payload_digest": digest, "refers_to": None if of is None else page_of(of),
    }, end + 4


class Bundle:
    """A bundle being written; `add` tells where a record went."""

    def __init__(self, out: BinaryIO, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes, self.sizes, self.written, self.held, self.parts = out, frame_bytes, [], 0, 0, []
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, data: bytes) -> tuple[int, int, int]:
        """(frame, offset in it, length)."""
        if self.parts and self.held + len(data) > self.frame_bytes:
            self.flush()
        at = (len(self.sizes), self.held, len(data))
        self.parts.append(data)
        self.held += len(data)
        return at

    def flush(self) -> None:
        if self.parts:
            packed = self.packer.compress(b"".join(self.parts))
            self.out.write(packed)
            self.sizes.append((len(packed), self.held))
            self.written += len(packed)
            self.held, self.parts = 0, []

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE))
        self.out.close()


def seek_table(f: BinaryIO) -> list[tuple[int, int, int]]:
    """(offset in the file, bytes there, bytes when decompressed) of each frame."""
    end = f.seek(0, 2)
    f.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8  # checksums may follow the sizes
    f.seek(end - 9 - n * width)
    raw, at, out = f.read(n * width), 0, []
    for i in range(n):
        packed, size = struct.unpack_from("<II", raw, i * width)
        out.append((at, packed, size))
        at += packed
    return out


def frame(f: BinaryIO, at: tuple[int, int, int]) -> bytes:
    f.seek(at[0])
    return zstandard.ZstdDecompressor().decompress(f.read(at[1]), max_output_size=at[2])


def records(f: BinaryIO) -> Iterator[dict]:
    """All records of a bundle, a frame in memory at a time."""
    for at in seek_table(f):
        data, place = frame(f, at), 0
        while place < len(data):
            r, place = parsed(data, place)
            yield r


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to) of (page_id, url, html)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = p.withColumn("payload_key", F.sha2("payload", 256))
    several = keyed.where(F.octet_length("payload") >= least_bytes).groupBy("payload_key").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("payload_rows")).where("payload_rows > 1")
    found = joined(keyed, "payload_key", cut(several), "payload_rows")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("first_page")), F.col("first_page"))
    return found.select("page_id", "url", "payload", other.alias("refers_to"))


def write_bundles(rows: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes rows (page_id, url, payload, refers_to) as bundles into `folder`; the index, kept there too, is returned."""

    def run(batches):
        fs, base = filesystem(folder)
        task = TaskContext.get()
        name = f"{base}/bundle-{task.partitionId():05d}-{task.taskAttemptId()}"
        bundle, path, number = None, "", 0
        for b in batches:
            out = []
            for page_id, url, payload, refers_to in zip(*(column(b, c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if bundle is None:
                    path, number = f"{name}-{number}.warc.zst", number + 1
                    bundle = Bundle(fs.open_output_stream(path, compression=None), frame_bytes)
                at = bundle.add(record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py()))
                out.append((record_id(page_id.as_py()), page_id.as_py(), path.rpartition("/")[2], *at))
                if bundle.written + bundle.held >= bundle_bytes:
                    bundle.close()
                    bundle = None
            if out:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["record_id", "page_id", "path", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return rows.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


_KINDS = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
_NAMES = [x.split()[0] for x in RECORD.split(", ")]


def _read(found: Iterator[dict], payloads: bool) -> Iterator[pa.RecordBatch]:
    """Batches of records of up to about 8 MB of payload."""
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], k) for n, k in zip(_NAMES, _KINDS, strict=True)], names=_NAMES)

    for r in found:
        if not payloads:
            r["payload"] = None
        held.append(r)
        size += 200 + len(r["payload"] or b"")
        if size >= 8 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def read_bundles(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Columns RECORD of all records in the bundles that the index of `folder` names, a bundle a task.

    payloads: whether to return the bytes of responses (they are read and their digests checked in any case).
    """

    def run(batches):
        fs, base = filesystem(folder)

        def every():
            for b in batches:
                for path in b.column(0).to_pylist():
                    with fs.open_input_file(f"{base}/{path}") as f:
                        yield from records(f)

        yield from _read(every(), payloads)

    paths = cut(spark.read.schema(INDEX).parquet(f"{folder}/index").select("path").distinct())
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(run, RECORD)


def fetch(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """Columns RECORD of the records that `wanted` (record_id) names, by reading only the frames that hold them."""

    def run(batches):
        fs, base = filesystem(folder)

        def every():
            for b in batches:
                places = sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
                f, table, path, number, data = None, [], None, None, b""
                for to, k, offset in places:
                    if to != path:
                        if f is not None:
                            f.close()
                        f, path, number = fs.open_input_file(f"{base}/{to}"), to, None
                        table = seek_table(f)
                    if k != number:
                        data, number = frame(f, table[k]), k
                    yield parsed(data, offset)[0]
                if f is not None:
                    f.close()

        yield from _read(every(), True)

    index = spark.read.schema(INDEX).parquet(f"{folder}/index").join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    return index.select("path", "frame", "offset").repartition("path", "frame").mapInArrow(run, RECORD)


def remove(spark: SparkSession, folder: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def op13_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_bundles(deduplicated(table(spark, sf_dir, "pages").select("page_id", "url", "html")), folder)
    out = cut(read_bundles(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove(spark, folder)
    return out


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS x, min(page_id) OVER (PARTITION BY t) AS first_page FROM p),
d AS (SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31) + 1, 1) FOR i IN range(32)], '') AS payload_digest FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to FROM d
"""
