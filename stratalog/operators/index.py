"""Sparse index, summary and floor lookups of sorted files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import FILE_HEADER_BYTES, INDEX_ENTRY_BYTES, INDEX_SAMPLE_BYTES, SUMMARY_SAMPLE

SAMPLE = "file_id long, token long, key string, data_offset long, entry long"


def sparse_index(partitions: DataFrame, sample: int = INDEX_SAMPLE_BYTES) -> DataFrame:
    """An entry for the first partition of a file, then for each whose frame brings the
    bytes since the last entry to `sample`.

    The total starts anew at each entry, which no window expresses. Files are sorted and
    streamed through, batch by batch, with the running state of one file in hand.
    """

    def pick(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, offset, since, entry = None, 0, 0, 0
        for b in rows:
            keep, offsets, entries = [], [], []
            for i, (f, size) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)):
                first = f != file
                if first:
                    file, offset, since, entry = f, FILE_HEADER_BYTES, 0, 0
                since += size
                if first or since >= sample:
                    keep.append(i), offsets.append(offset), entries.append(entry)
                    since, entry = 0, entry + 1
                offset += size
            part = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(offsets, pa.int64()), pa.array(entries, pa.int64())], ["file_id", "token", "key", "data_offset", "entry"])

    ordered = partitions.select(F.col("file_id").cast("long").alias("file_id"), "token", "key", F.col("frame").cast("long").alias("frame"))
    return ordered.repartition("file_id").sortWithinPartitions("file_id", "token", "key").mapInArrow(pick, SAMPLE)


def with_index_offsets(index: DataFrame) -> DataFrame:
    """Add each entry's own offset in the index file."""
    before = Window.partitionBy("file_id").orderBy("entry").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("key") + INDEX_ENTRY_BYTES
    return index.withColumn("index_offset", F.coalesce(F.sum(size).over(before), F.lit(0)) + FILE_HEADER_BYTES)


def summary(index: DataFrame, sample: int = SUMMARY_SAMPLE) -> DataFrame:
    """Every 128th entry, with its offset in the index file."""
    return with_index_offsets(index).where(F.col("entry") % sample == 0).select("file_id", "token", "key", "index_offset")


def floor(asked: DataFrame, entries: DataFrame, value: str, else_first: bool = False) -> DataFrame:
    """For each row of asked(file_id, token, key) (the files whose range holds a key) the
    value of the last entry not after the key, as an as-of lookup by a window over keys
    and entries of a file together; with else_first, keys before every entry get the first
    one. One shuffle by file, no pairs of keys and entries."""
    ask = asked.select("file_id", "token", "key").distinct().withColumns({"_ask": F.lit(1), "_v": F.lit(None).cast("long")})
    both = ask.unionByName(entries.select("file_id", "token", "key", F.lit(0).alias("_ask"), F.col(value).cast("long").alias("_v")))
    run = Window.partitionBy("file_id").orderBy("token", "key", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("_v", ignorenulls=True).over(run)
    if else_first:
        # where none comes before, the first that follows is the file's first: the same for
        # all rows and found once (Spark walks a frame that begins at the row anew for each)
        whole = Window.partitionBy("file_id").orderBy("token", "key", "_ask").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        found = F.coalesce(found, F.first("_v", ignorenulls=True).over(whole))
    return both.withColumn("at", found).where("_ask = 1").select("file_id", "key", F.col("at").alias(value))

