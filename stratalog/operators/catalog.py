"""The catalog: one row per file, and what it allows to be skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import record_bytes
from ..model import FILE_HEADER_BYTES, FRAME_BYTES

BOUNDS = ("min_token", "min_key", "max_token", "max_key")


def partitions(file_cells: DataFrame) -> DataFrame:
    """One row per file and key: cells, frame bytes, newest timestamp."""
    by = file_cells.groupBy("file_id", "level", "token", "key")
    return by.agg(F.count("*").alias("cells"), (record_bytes() + FRAME_BYTES).alias("frame"), F.max("ts").alias("ts"))


def statistics(file_cells: DataFrame) -> DataFrame:
    """The statistics of every file: two aggregations, the second over keys only."""
    low, high = F.min(F.struct("token", "key")), F.max(F.struct("token", "key"))
    stats = partitions(file_cells).groupBy("file_id", "level").agg(
        F.count("*").alias("partition_count"), F.sum("cells").alias("cell_count"), low.alias("low"), high.alias("high"),
        (F.sum("frame") + FILE_HEADER_BYTES).alias("data_size_bytes"), F.floor(F.max("ts") / 1000).alias("created_at_ms"),
    )
    return stats.select(
        "file_id", "level", "partition_count", "cell_count", F.col("low.token").alias("min_token"), F.col("low.key").alias("min_key"),
        F.col("high.token").alias("max_token"), F.col("high.key").alias("max_key"), "data_size_bytes", "created_at_ms",
    )


def rebuilt(listed: DataFrame, existing: DataFrame) -> DataFrame:
    """Files whose data exists, newest first by name; a missing level is 0."""
    kept = listed.join(existing.select("file_id").distinct(), "file_id", "left_semi").withColumn("level", F.coalesce("level", F.lit(0)))
    return kept.withColumn("catalog_pos", F.row_number().over(Window.orderBy(F.desc(F.col("file_id").cast("string")))) - 1)


def covers(key_token: str = "token", key: str = "key") -> Column:
    """A file's range may hold the key; unknown bounds hold everything."""
    at = F.struct(F.col(key_token), F.col(key))
    low, high = F.struct("min_token", "min_key"), F.struct("max_token", "max_key")
    return F.col("min_key").isNull() | F.col("max_key").isNull() | ((at >= low) & (at <= high))


#: Bits of a token that name its bin.
BIN_BITS = 10


def bin_of(token: str = "token", bits: int = BIN_BITS) -> Column:
    return F.shiftright(F.col(token), 64 - bits).cast("int")


def binned(catalog: DataFrame, bits: int = BIN_BITS) -> DataFrame:
    """A row for each file and bin that its range touches (all bins where it has no
    bounds), with the first such bin. From level 1 up ranges are disjoint, so a level adds
    a row per file and bin; only the few files of level 0 are wide. Give more bits to
    catalogs of many more files than bins."""
    open_, last = F.col("min_token").isNull() | F.col("max_token").isNull(), 1 << (bits - 1)
    first = F.when(open_, -last).otherwise(bin_of("min_token", bits))
    end = F.when(open_, last - 1).otherwise(bin_of("max_token", bits))
    return catalog.withColumn("first_bin", first).withColumn("bin", F.explode(F.sequence(F.col("first_bin"), F.greatest("first_bin", end))))


def candidates(keys: DataFrame, catalog: DataFrame) -> DataFrame:
    """keys(token, key) with every file whose range holds them: an equi-join by bin, then
    the ranges. The catalog (a row per file, not per cell) is the side that Spark may
    broadcast by its size."""
    files = binned(catalog).drop("first_bin").withColumnRenamed("bin", "_bin")
    return keys.join(files, (bin_of() == F.col("_bin")) & covers()).drop("_bin")


def overlaps(catalog: DataFrame) -> DataFrame:
    """Pairs of files with overlapping closed ranges, from an equi-join by bin; a pair is
    reported in the first bin that both touch."""
    a = binned(catalog.select("file_id", "level", *BOUNDS))
    b = a.select(*[F.col(c).alias("b_" + c) for c in a.columns])
    meet = (F.col("bin") == F.col("b_bin")) & (F.col("bin") == F.greatest("first_bin", "b_first_bin"))
    low_high = F.struct("min_token", "min_key") <= F.struct("b_max_token", "b_max_key")
    high_low = F.struct("b_min_token", "b_min_key") <= F.struct("max_token", "max_key")
    open_ = F.col("min_key").isNull() | F.col("max_key").isNull() | F.col("b_min_key").isNull() | F.col("b_max_key").isNull()
    return a.join(b, meet & (F.col("file_id") < F.col("b_file_id")) & (open_ | (low_high & high_low))).select("file_id", "level", F.col("b_file_id").alias("other_id"), F.col("b_level").alias("other_level"))


def level_conflicts(catalog: DataFrame) -> DataFrame:
    """Files of one level from 1 up that overlap the one before them: a window, no join.
    Empty when the invariant holds."""
    before = Window.partitionBy("level").orderBy("min_token", "min_key", "max_token", "max_key", "file_id").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(F.struct("max_token", "max_key")).over(before)
    return catalog.where("level >= 1").withColumn("top", top).where(F.struct("min_token", "min_key") <= F.col("top")).select("level", "file_id")


def level_summary(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("level").agg(F.count("*").alias("sstable_count"), F.sum("data_size_bytes").alias("total_bytes"))


def max_log_position(positions: DataFrame) -> DataFrame:
    """The newest (segment_id, position)."""
    top = positions.agg(F.max(F.struct("segment_id", "position")).alias("p"))
    return top.select("p.segment_id", "p.position")


def min_log_position(positions: DataFrame) -> DataFrame:
    """The oldest (segment_id, position)."""
    low = positions.agg(F.min(F.struct("segment_id", "position")).alias("p"))
    return low.select("p.segment_id", "p.position")


def with_age(catalog: DataFrame, now_ms: int) -> DataFrame:
    """Add the whole seconds since each file was made."""
    return catalog.withColumn("age_seconds", F.expr(f"({now_ms}L - created_at_ms) div 1000"))
