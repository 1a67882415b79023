"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent zstd frames. A skippable frame maps each record's
identifier to its frame, its offset inside the decompressed frame and its length; a last
skippable frame is the seek table of the public seekable format (sizes of every frame,
footer with magic 0x8F92EAB1). One record is read by decompressing one frame.

Archives are written by the executors into a folder that all of them share. A task writes
under a fresh name and returns it; only names in the manifest count, so a task that is
tried again leaves at most a file that nothing names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, lean, looked_up, scratch_path, written

# Fixed values of the seekable format.
SKIPPABLE_SEEK, SKIPPABLE_INDEX, SEEK_MAGIC = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
#: Uncompressed bytes after which a frame, and compressed bytes after which an archive, is closed.
FRAME_BYTES, ARCHIVE_BYTES = 1 << 20, 1 << 28
DATE = "1970-01-01T00:00:00Z"
INDEX = np.dtype([("id", "<i8"), ("known", "<u1"), ("frame", "<u4"), ("offset", "<u4"), ("length", "<u4")])
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def open_file(uri: str, mode: str) -> BinaryIO:
    """Local paths and file: URIs directly, others through Arrow's file systems."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return open(parts.path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path) if "w" in mode else store.open_input_file(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(record_id: int | None) -> str:
    return f"<urn:stratalog:page:{'' if record_id is None else record_id}>"


def _id(name: str) -> int | None:
    number = name.rpartition(":")[2].rstrip(">")
    return int(number) if number else None


def record(record_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit carries the HTTP header but no payload."""
    block = HTTP % len(payload) + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(record_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    out = {"record_id": _id(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:")}
    out["payload_bytes"] = int(re.search(rb"Content-Length: (\d+)", http)[1])
    out["refers_to"] = _id(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    if out["record_type"] == "response":
        if len(payload) != out["payload_bytes"] or digest(payload) != out["payload_digest"]:
            raise ValueError(f"record {fields['WARC-Record-ID']}: the payload does not match its digest")
        out["payload"] = payload
    return out


class BundleWriter:
    """Writes one archive; frames are closed at frame_bytes."""

    def __init__(self, file: BinaryIO, frame_bytes: int = FRAME_BYTES):
        self.file, self.frame_bytes, self.zip = file, frame_bytes, zstandard.ZstdCompressor(level=3)
        self.frames, self.index, self.open, self.size, self.bytes = [], [], [], 0, 0

    def add(self, record_id: int | None, raw: bytes) -> None:
        if self.open and self.size + len(raw) > self.frame_bytes:
            self.end_frame()
        self.index.append((record_id or 0, record_id is not None, len(self.frames), self.size, len(raw)))
        self.open.append(raw)
        self.size += len(raw)

    def end_frame(self) -> None:
        if self.open:
            frame = self.zip.compress(b"".join(self.open))
            self.file.write(frame)
            self.frames.append((len(frame), self.size))
            self.bytes += len(frame)
            self.open, self.size = [], 0

    def close(self) -> None:
        self.end_frame()
        index = np.array(self.index, INDEX).tobytes()
        self.file.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        frames = [*self.frames, (len(index) + 8, 0)]  # the index is a frame to the seek table, too
        table = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class BundleReader:
    """Finds records of one archive by its seek table and index."""

    def __init__(self, file: BinaryIO):
        self.file = file
        end = file.seek(0, 2)
        file.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        file.seek(end - 9 - 8 * n)
        sizes = np.frombuffer(file.read(8 * n), "<u4").reshape(n, 2).astype(np.int64)
        self.start, self.sizes = np.cumsum(sizes[:, 0]) - sizes[:, 0], sizes[:-1]
        file.seek(self.start[-1] + 8)
        self.index = np.frombuffer(file.read(sizes[-1, 0] - 8), INDEX)

    def frame(self, n: int) -> bytes:
        self.file.seek(self.start[n])
        return zstandard.ZstdDecompressor().decompress(self.file.read(self.sizes[n, 0]), max_output_size=int(self.sizes[n, 1]))

    def records(self) -> Iterator[dict]:
        for n in range(len(self.sizes)):
            data = self.frame(n)
            for r in self.index[self.index["frame"] == n]:
                yield parse(data[r["offset"] : r["offset"] + r["length"]])

    def find(self, record_id: int) -> dict | None:
        """One record, by decompressing its frame alone."""
        at = np.flatnonzero((self.index["id"] == record_id) & (self.index["known"] == 1))
        if not len(at):
            return None
        r = self.index[at[0]]
        return parse(self.frame(r["frame"])[r["offset"] : r["offset"] + r["length"]])


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add refers_to and revisit. Of rows with equal payloads of at least least_bytes, the
    smallest page_id is the response; smaller payloads are all responses. The smallest id
    of each payload comes from an aggregation with map-side combining; only payloads held
    more than once are joined back, and the pages of a very common one are dealt out."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("content", F.unhex(F.sha2("payload", 256)))
    first = rows.select("page_id", "content").groupBy("content").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
    revisit = (F.length("payload") >= least_bytes) & F.col("rows").isNotNull() & ~F.expr("page_id <=> first")
    found = looked_up(rows, first.where("rows > 1"), "content", "page_id")
    return found.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write records(page_id, url, payload, refers_to, revisit) into archives in folder;
    the manifest (path, records, bytes) is itself a written table."""
    spark = records.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)

    @lean
    def write(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = file = bundle = None

        def done() -> pa.RecordBatch:
            bundle.close()
            file.close()
            return batches({"path": ([path], pa.string()), "records": ([len(bundle.index)], pa.int64()), "bytes": ([bundle.bytes], pa.int64())})

        for b in rows:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bundle is None:
                    path = f"{folder}/part-{uuid.uuid4().hex}.warc.zst"
                    file = open_file(path, "wb")
                    bundle = BundleWriter(file, frame_bytes)
                bundle.add(r[0], record(*r))
                if bundle.bytes >= archive_bytes:
                    yield done()
                    bundle = None
        if bundle is not None:
            yield done()

    return written(records.select("page_id", "url", "payload", "refers_to", "revisit").mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def read_bundles(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every
    record of the archives that the manifest names."""
    out = {"record_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string()}

    @lean
    def read(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for path in b.column(0).to_pylist():
                with open_file(path, "rb") as file:
                    got = []
                    for r in BundleReader(file).records():
                        got.append({k: r[k] for k in out})
                        if len(got) == 2000:
                            yield batches({k: ([g[k] for g in got], t) for k, t in out.items()})
                            got = []
                    yield batches({k: ([g[k] for g in got], t) for k, t in out.items()})

    paths = manifest.select("path").repartition(max(1, manifest.count()))
    got = paths.mapInArrow(read, "record_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
    return got.withColumnRenamed("record_id", "page_id")


def warc_round_trip(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write pages(page_id, url, html) as archives and read them back: a row per page.

    A null html is an empty payload, a null url no target; other columns are not read.
    Rows with a null page_id sort after the others (they are revisits where an equal
    payload has an id) and come back with a null id; rows repeated with the smallest id
    of their payload are all responses. An empty table writes no archive.
    """
    where = folder or scratch_path(pages.sparkSession, "warc")
    return read_bundles(write_bundles(with_revisits(pages, least_bytes), where))
