"""Reads over tiers: active memory, flushing memory, level-0 files newest first, then one
file per deeper level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .catalog import bin_of, candidates
from .reconcile import memtable_merge

MEM, FLUSHING, FILES = 0, 1, 2


def places(keys: DataFrame, memory: DataFrame, catalog: DataFrame) -> DataFrame:
    """(key, tier, level, file_id, place): where each key is looked for, in order. From
    level 1 up only the first file by catalog position whose range holds the key."""
    newest = Window.partitionBy("key", "level").orderBy("catalog_pos")
    files = candidates(keys, catalog).withColumn("_n", F.row_number().over(newest)).where("level = 0 or _n = 1")
    order = Window.partitionBy("key").orderBy("level", F.when(F.col("level") == 0, -F.col("created_at_ms")).otherwise(0), "catalog_pos")
    files = files.withColumn("place", F.row_number().over(order)).select("key", F.lit(FILES).alias("tier"), "level", "file_id", "place")
    held = memory.join(keys.select("key"), "key", "left_semi").select("key", "tier").distinct()
    held = held.select("key", "tier", F.lit(-1).alias("level"), F.lit(None).cast("long").alias("file_id"), F.lit(0).alias("place"))
    return held.unionByName(files)


def first_hits(keys: DataFrame, memory: DataFrame, file_cells: DataFrame, catalog: DataFrame) -> DataFrame:
    """(key, tier, file_id): the first place that holds the key. memory has a tier column."""
    holds = file_cells.select("key", "file_id").distinct()
    place = places(keys, memory, catalog)
    found = place.where(F.col("tier") < FILES).unionByName(place.where(F.col("tier") == FILES).join(holds, ["key", "file_id"], "left_semi").select(*place.columns))
    best = found.groupBy("key").agg(F.min_by(F.struct("tier", "file_id"), F.struct("tier", "place")).alias("hit"))
    return best.select("key", "hit.tier", "hit.file_id")


def read_first_hit(keys: DataFrame, memory: DataFrame, file_cells: DataFrame, catalog: DataFrame) -> DataFrame:
    """All cells of the first tier that has the key, whatever their timestamps; older
    columns in later tiers stay hidden. Tombstones are returned."""
    hits = first_hits(keys, memory, file_cells, catalog)
    cols = ["key", "name", "value", "ts", "flags", "tier"]
    mem = memory.join(hits.where(F.col("tier") < FILES).select("key", "tier"), ["key", "tier"], "left_semi").select(*cols)
    disk = file_cells.join(hits.where(F.col("tier") == FILES).select("key", "file_id"), ["key", "file_id"], "left_semi").withColumn("tier", F.lit(FILES)).select(*cols)
    return mem.unionByName(disk)


def read_reconciled(keys: DataFrame, memory: DataFrame, file_cells: DataFrame) -> DataFrame:
    """The winners over all tiers."""
    cols = ["key", "name", "value", "ts", "flags", "ttl", "seq"]
    every = memory.select(*cols).unionByName(file_cells.select(*cols)).join(keys.select("key"), "key", "left_semi")
    return memtable_merge(every)


def trace(keys: DataFrame, memory: DataFrame, file_cells: DataFrame, catalog: DataFrame) -> DataFrame:
    """A row for each file visited before the read of a key ended: whether the filter let
    it pass and whether the file held the key."""
    holds = file_cells.select("key", "file_id").distinct().withColumn("holds", F.lit(True))
    place = places(keys, memory, catalog)
    misses = place.where(F.col("tier") == FILES).join(memory.select("key").distinct(), "key", "left_anti")
    seen = misses.join(holds, ["key", "file_id"], "left").withColumn("holds", F.coalesce("holds", F.lit(False)))
    before = Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    visited = seen.withColumn("_done", F.coalesce(F.max(F.col("holds").cast("int")).over(before), F.lit(0))).where("_done = 0").drop("_done")
    asked = visited.select("file_id", "key").join(keys.select("key", "token"), "key")
    file_keys = file_cells.select("file_id", "token", "key").distinct()
    return visited.join(bloom.probe(asked, file_keys), ["file_id", "key"]).select("key", "file_id", "place", "might_contain", "holds")


def lookup_counters(traced: DataFrame) -> DataFrame:
    """One row: files scanned, passed and stopped by filters, reads from disk that found
    and did not find the key."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    passed = F.col("might_contain")
    return traced.agg(F.count("*").alias("scanned"), n(passed).alias("bloom_hits"), n(~passed).alias("bloom_misses"), n(F.col("holds")).alias("found"), n(passed & ~F.col("holds")).alias("false_positives"))


def read_amplification(keys: DataFrame, memory: DataFrame, file_cells: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: reads, hits per kind of tier, files scanned and scans per read that went
    to files."""
    steps = trace(keys, memory, file_cells, catalog)
    scans = steps.agg(F.count("*").alias("scanned"), F.coalesce(F.sum(F.col("holds").cast("long")), F.lit(0)).alias("sst_hits"))
    reads = keys.select("key").distinct().join(memory.select("key").distinct().withColumn("m", F.lit(1)), "key", "left").agg(F.count("*").alias("reads"), F.count("m").alias("mem_hits"))
    to_files = F.col("reads") - F.col("mem_hits")
    return reads.join(scans).select("reads", "mem_hits", "sst_hits", "scanned", F.when(to_files > 0, F.col("scanned") / to_files).otherwise(0.0).alias("scans_per_read"))


def multi_get(keys: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of a list of keys. Spark broadcasts the list if its size allows."""
    return cells.join(keys.select("key").distinct(), "key", "left_semi")


def token_places(keys: DataFrame, bits: int = 16) -> DataFrame:
    """keys(token, key) with their place in token order: sorted inside the bins of tokens,
    each bin placed after the counts of those before it (65,536 counts at most)."""
    binned_ = keys.withColumn("_bin", bin_of(bits=bits))
    sizes = binned_.groupBy("_bin").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_bin", F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_bin").orderBy("token", "key"))
    return binned_.withColumn("_nth", nth).join(starts, "_bin").withColumn("place", F.col("_nth") + F.col("_before")).drop("_bin", "_nth", "_before")


def token_range(cells: DataFrame, low: int, high: int) -> DataFrame:
    """Cells with tokens in a range, both ends included."""
    return cells.where(F.col("token").between(low, high))
