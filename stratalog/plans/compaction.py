"""Compaction: which files to merge, and the merge.

The catalog has a row per file and is small beside the cells; plans are DataFrames over
it, execution is one aggregation over the cells of the inputs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as m
from ..operators.reconcile import compaction_merge, purge


class Strategy(Protocol):
    def plan(self, catalog: DataFrame) -> DataFrame:
        """(file_id, input_pos, output_level, reason), no rows for nothing to do."""


def stcs_buckets(catalog: DataFrame) -> DataFrame:
    """(file_id, data_size_bytes, bucket, place): by ascending size, ties by catalog
    position, a file joins the open bucket while the bucket's first (smallest) file is at
    least half as large. A fold that starts anew at each bucket, so one task streams the
    sorted catalog, a row per file, with the open bucket in hand."""

    def fold(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, bucket, place = None, -1, 0
        for b in rows:
            out = []
            for size in b.column(1).to_pylist():
                if first is not None and size and m.STCS_LOW <= first / size <= m.STCS_HIGH:
                    place += 1
                else:
                    first, bucket, place = size, bucket + 1, 0
                out.append((bucket, place))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([o[k] for o in out], pa.int32()) for k in (0, 1))], ["file_id", "data_size_bytes", "bucket", "place"])

    files = catalog.select(F.col("file_id").cast("long").alias("file_id"), F.col("data_size_bytes").cast("long").alias("data_size_bytes"), "catalog_pos")
    ordered = files.repartition(1).sortWithinPartitions("data_size_bytes", "catalog_pos").drop("catalog_pos")
    return ordered.mapInArrow(fold, "file_id long, data_size_bytes long, bucket int, place int")


def stcs_select(buckets: DataFrame) -> DataFrame:
    """The one bucket to compact: most files (at least 4), then largest mean size."""
    sized = buckets.groupBy("bucket").agg(F.count("*").alias("files"), F.avg("data_size_bytes").alias("mean_bytes")).where(F.col("files") >= m.STCS_LEAST)
    return sized.orderBy(F.desc("files"), F.desc("mean_bytes"), "bucket").limit(1)


class SizeTiered:
    def plan(self, catalog: DataFrame) -> DataFrame:
        """At most 32 inputs, the smallest first; only those are replaced."""
        buckets = stcs_buckets(catalog)
        chosen = buckets.join(stcs_select(buckets).select("bucket"), "bucket", "left_semi").where(F.col("place") < m.STCS_MOST)
        return chosen.select("file_id", F.col("place").alias("input_pos"), F.lit(0).alias("output_level"), F.lit("size-tiered").alias("reason"))


def level_target(level: Column) -> Column:
    return F.when(level <= 0, F.lit((1 << 63) - 1)).otherwise((m.LCS_L1_BYTES * F.pow(F.lit(float(m.LCS_FANOUT)), level - 1)).cast("long"))


def level_scores(catalog: DataFrame) -> DataFrame:
    by = catalog.where("level >= 1").groupBy("level").agg(F.sum("data_size_bytes").alias("total_bytes"))
    target = level_target(F.col("level"))
    return by.withColumn("target_bytes", target).withColumn("score", F.col("total_bytes") / F.col("target_bytes"))


def overlap_closure(seeds: DataFrame, pool: DataFrame) -> DataFrame:
    """Files of pool that touch a seed, or a file that does, and so on. Closed ranges form
    islands: sorted by start, a new one begins past every end so far; those with a seed
    count. A file without bounds touches everything. Ranges must not be inverted."""
    cols = ["file_id", "min_token", "min_key", "max_token", "max_key"]
    every = seeds.select(*cols, F.lit(1).alias("_seed")).unionByName(pool.select(*cols, F.lit(0).alias("_seed")))
    order = Window.orderBy("min_token", "min_key", "max_token", "max_key", "file_id")
    top = F.max(F.struct("max_token", "max_key")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = every.withColumn("_new", F.coalesce(F.struct("min_token", "min_key") > top, F.lit(True)).cast("int"))
    island = starts.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    all_ = Window.partitionBy(F.lit(0))
    marked = island.withColumn("_has", F.max("_seed").over(Window.partitionBy("_island")))
    marked = marked.withColumn("_open", F.max((F.col("min_key").isNull() | F.col("max_key").isNull()).cast("int")).over(all_)).withColumn("_any", F.max("_seed").over(all_))
    return marked.where("_seed = 0 and (_has = 1 or (_open = 1 and _any = 1))").select(*cols)


class Leveled:
    def plan(self, catalog: DataFrame) -> DataFrame:
        """All of level 0 once it has 4 files, else the largest file of the level most
        over its target; with what they overlap one level down. Level and size choices
        are read from the catalog's aggregates on the driver (a row per level)."""
        none = catalog.limit(0)
        waiting = catalog.where("level = 0").count()
        if waiting >= m.LCS_L0_FILES:
            seeds, level, reason = catalog.where("level = 0"), 0, "level 0 is full"
        else:
            over = level_scores(catalog).where("score > 1.0").orderBy(F.desc("score"), "level").limit(1).collect()
            if not over:
                return none.select("file_id", F.lit(0).alias("input_pos"), F.lit(0).alias("output_level"), F.lit("").alias("reason"))
            level, reason = over[0]["level"], f"level {over[0]['level']} is over its target"
            seeds = catalog.where(F.col("level") == level).orderBy(F.desc("data_size_bytes"), "catalog_pos").limit(1)
        down = overlap_closure(seeds, catalog.where(F.col("level") == level + 1))
        inputs = seeds.select("file_id", F.lit(0).alias("_kind"), "catalog_pos").unionByName(
            catalog.join(down, "file_id", "left_semi").select("file_id", F.lit(1).alias("_kind"), "catalog_pos")
        )
        place = F.row_number().over(Window.orderBy("_kind", "catalog_pos")) - 1
        return inputs.select("file_id", place.alias("input_pos"), F.lit(level + 1).alias("output_level"), F.lit(reason).alias("reason"))


def execute(plan: DataFrame, file_cells: DataFrame, now: int, grace_seconds: int = 0) -> DataFrame:
    """The cells of the output: merged, then purged. The plan has at most a row per file
    and is the side that Spark may broadcast by its size."""
    inputs = file_cells.join(plan.select("file_id", "input_pos", "output_level"), "file_id")
    merged = compaction_merge(inputs, by=("key", "token", "output_level", "name"))
    return purge(merged, now, grace_seconds).withColumnRenamed("output_level", "level")


def strategy(name: str) -> Strategy:
    return {"STCS": SizeTiered, "LCS": Leveled}[name.upper()]()
