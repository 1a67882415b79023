"""Binary log segments: a 32-byte header, then frames of length, record and CRC-32C.

A record is the key, the number of cells, and each cell's name, flags, timestamp, ttl and
value; integers are big-endian. Reading stops at the first bad frame of a segment, as a
torn write leaves one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import _crc_table, crc32c
from ..model import MOST_RECORD_BYTES

HEADER, MAGIC = 32, b"STRATLOG"
RECORD = "segment_id long, offset long, key string, name string, value string, ts long, flags int, ttl int"


def encode_record(key: str, cells: list[tuple[str, str | None, int, int, int]]) -> bytes:
    """cells: (name, value, ts, flags, ttl), by name."""
    k = key.encode()
    out = [struct.pack(">H", len(k)), k, struct.pack(">H", len(cells))]
    for name, value, ts, flags, ttl in sorted(cells, key=lambda c: c[0]):
        n, v = name.encode(), b"" if value is None else value.encode()
        out += [struct.pack(">H", len(n)), n, struct.pack(">BqiI", flags, ts, ttl, len(v)), v]
    return b"".join(out)


def decode_record(data: bytes) -> tuple[str, list[tuple[str, str | None, int, int, int]]]:
    (size,) = struct.unpack_from(">H", data)
    key, at = data[2 : 2 + size].decode(), 2 + size
    (count,) = struct.unpack_from(">H", data, at)
    at, cells = at + 2, []
    for _ in range(count):
        (size,) = struct.unpack_from(">H", data, at)
        name, at = data[at + 2 : at + 2 + size].decode(), at + 2 + size
        flags, ts, ttl, size = struct.unpack_from(">BqiI", data, at)
        at += 17
        cells.append((name, None if flags & 1 else data[at : at + size].decode(), ts, flags, ttl))
        at += size
    return key, cells


def frame(record: bytes) -> bytes:
    return struct.pack(">I", len(record)) + record + struct.pack(">I", crc32c(record))


def header(segment_id: int) -> bytes:
    return MAGIC + struct.pack(">q", segment_id) + bytes(HEADER - 16)


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the valid prefix of a segment; nothing without its header."""
    if data[: len(MAGIC)] != MAGIC:
        return
    table, at = _crc_table(), HEADER
    while at + 8 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        if not 0 < size <= MOST_RECORD_BYTES or at + 8 + size > len(data):
            return
        record = data[at + 4 : at + 4 + size]
        if struct.unpack_from(">I", data, at + 4 + size)[0] != crc32c(record, table):
            return
        yield at, record
        at += 8 + size


def truncated(data: bytes) -> bytes:
    """A segment without what follows its last good frame; nothing without its header."""
    if data[: len(MAGIC)] != MAGIC:
        return b""
    end = HEADER
    for at, record in frames(data):
        end = at + 8 + len(record)
    return data[:end]


def write_segment(spark: SparkSession, folder: str, segment_id: int, records: Iterable[bytes]) -> str:
    """Write encoded records as one segment, on any Hadoop file system; its path. A log has
    one writer, so this is the driver's work."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{segment_id}.clog")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(header(segment_id)))
        for record in records:
            out.write(bytearray(frame(record)))
        out.hsync()
    finally:
        out.close()
    return path.toString()


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of all *.clog segments below folder, each a task's work; the segment's number
    is in its name, 0 if it is not a number."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.clog").load(folder)
    number = F.coalesce(F.expr("try_cast(regexp_extract(path, '([0-9]+)[.]clog$', 1) as bigint)"), F.lit(0).cast("long"))

    def decode(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
        for b in rows:
            for segment, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out = []
                for at, record in frames(data.as_buffer().to_pybytes()):
                    key, cells = decode_record(record)
                    out += [(segment, at, key, *c) for c in cells]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(8)], names)

    cols = "segment_id long, offset long, key string, name string, value string, ts long, flags int, ttl int"
    return files.select(number.alias("segment_id"), "content").mapInArrow(decode, cols)
