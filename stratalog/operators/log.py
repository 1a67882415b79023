"""Operators over log segments: (segment_id, offset or seq, record...)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import cell_bytes
from ..model import FRAME_BYTES, SEGMENT_BYTES


def frames(mutations: DataFrame) -> DataFrame:
    """Bytes of each single-cell record on the log: frame, key and cell."""
    return mutations.withColumn("frame", cell_bytes() + F.octet_length("key") + 4 + FRAME_BYTES)


def replay_prefix(log: DataFrame, order: str = "seq", bad: str = "bad_crc") -> DataFrame:
    """Records before the first bad one of each segment."""
    run = Window.partitionBy("segment_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("_bad", F.max(F.col(bad).cast("int")).over(run)).where("_bad = 0").drop("_bad")


def replay_stats(log: DataFrame, order: str = "seq", bad: str = "bad_crc") -> DataFrame:
    """One row: segments, rows replayed and corrupt segments. No window is needed: the
    first bad record of a segment is an aggregate."""
    first = log.groupBy("segment_id").agg(F.min(F.when(F.col(bad), F.col(order))).alias("cut"))
    rows = log.join(first, "segment_id").groupBy("segment_id").agg(F.sum(F.when(F.col("cut").isNull() | (F.col(order) < F.col("cut")), 1).otherwise(0)).alias("rows"), F.max(F.col("cut").isNotNull().cast("int")).alias("bad"))
    return rows.agg(F.count("*").alias("segments"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("corruptions"))


def offsets(log: DataFrame, header: int = 32) -> DataFrame:
    """Offset of each record in its segment, after the header."""
    before = Window.partitionBy("segment_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return frames(log).withColumn("offset", F.coalesce(F.sum("frame").over(before), F.lit(0)) + header)


def last_good(log: DataFrame) -> DataFrame:
    """End of the valid prefix of each segment."""
    good = replay_prefix(offsets(log))
    ends = good.groupBy("segment_id").agg(F.max(F.col("offset") + F.col("frame")).alias("position"))
    return log.select("segment_id").distinct().join(ends, "segment_id", "left").select("segment_id", F.coalesce("position", F.lit(32)).cast("long").alias("position"))


def recycled(segments: DataFrame, flushed: int) -> DataFrame:
    """Segments that remain once everything up to segment `flushed` is in files; the
    active one always does."""
    return segments.where(~(~F.col("active") & (F.col("segment_id") <= flushed)))


def rolled(log: DataFrame, limit: int = SEGMENT_BYTES, header: int = 32) -> DataFrame:
    """Segment of each record when a new one begins after the append that reaches limit.

    The running total starts anew at each roll, which no window expresses; one writer's
    log is one sequence, so each `writer` is a group of its own.
    """

    def runs(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, segment, writer = header, 0, None
        for b in rows:
            out = np.empty(b.num_rows, np.int64)
            for i, (w, size) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if w != writer:
                    total, segment, writer = header, 0, w
                out[i] = segment
                total += size
                if total >= limit:
                    total, segment = header, segment + 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], ["writer", "seq", "segment"])

    ordered = frames(log).select("writer", "seq", "frame").repartition("writer").sortWithinPartitions("writer", "seq")
    return ordered.mapInArrow(runs, "writer long, seq long, segment long")
