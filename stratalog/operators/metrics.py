"""Counters and ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import memory_bytes
from ..model import MEMTABLE_BYTES


def memtable_size(mutations: DataFrame, by: str = "generation") -> DataFrame:
    """Estimated bytes of each memory table: every put counts in full, overwrites too."""
    return mutations.groupBy(by).agg(F.sum(memory_bytes()).alias("estimated_bytes"), F.count("*").alias("puts"))


def flush_due(mutations: DataFrame, limit: int = MEMTABLE_BYTES, by: str = "generation") -> DataFrame:
    return memtable_size(mutations, by).withColumn("due", F.col("estimated_bytes") >= limit)


def tier_share(amplification: DataFrame) -> DataFrame:
    """One row: what share of the reads memory and files answered and none did, in whole
    percent, halves up."""
    total = F.greatest("reads", F.lit(1))
    misses = F.col("reads") - F.col("mem_hits") - F.col("sst_hits")
    share = lambda n: F.floor(n * 100 / total + 0.5).cast("long")
    return amplification.select(share(F.col("mem_hits")).alias("memory_percent"), share(F.col("sst_hits")).alias("files_percent"), share(misses).alias("miss_percent"))


def log_metrics(rolled: DataFrame, mutations: DataFrame) -> DataFrame:
    """One row: appends, their estimated bytes, and rolls of all writers' logs."""
    rolls = rolled.groupBy("writer").agg(F.max("segment").alias("rolls")).agg(F.coalesce(F.sum("rolls"), F.lit(0)).alias("rolls"))
    writes = mutations.agg(F.count("*").alias("writes"), F.coalesce(F.sum(memory_bytes()), F.lit(0)).alias("estimated_bytes"))
    return writes.join(rolls)  # two single rows


def engine_stats(mutations: DataFrame, catalog: DataFrame, amplification: DataFrame) -> DataFrame:
    """One row of writes, flushes, files, reads and the share of reads that hit."""
    writes = mutations.agg(F.count("*").alias("writes"), F.countDistinct("segment_id").alias("log_segments"), F.countDistinct("generation").alias("memtables"))
    files = catalog.agg(F.count("*").alias("sstables"), F.coalesce(F.sum("data_size_bytes"), F.lit(0)).alias("sstable_bytes"))
    hits = F.col("mem_hits") + F.col("sst_hits")
    reads = amplification.select("reads", "mem_hits", "sst_hits", "scanned", F.when(F.col("reads") == 0, 0.0).otherwise(hits / F.col("reads")).alias("hit_ratio"))
    return writes.join(files).join(reads)  # three single rows


def write_amplification(flushed: DataFrame, plan: DataFrame, catalog: DataFrame, output: DataFrame) -> DataFrame:
    """One row: bytes flushed, read and written by a compaction, reclaimed, and bytes
    written in all per byte flushed. output: the catalog rows of the new files."""
    read = catalog.join(plan.select("file_id"), "file_id", "left_semi").agg(F.coalesce(F.sum("data_size_bytes"), F.lit(0)).alias("bytes_read"))
    wrote = output.agg(F.coalesce(F.sum("data_size_bytes"), F.lit(0)).alias("bytes_written"))
    first = flushed.agg(F.coalesce(F.sum("data_size_bytes"), F.lit(0)).alias("bytes_flushed"))
    one = first.join(read).join(wrote)
    return one.withColumn("bytes_reclaimed", F.col("bytes_read") - F.col("bytes_written")).withColumn(
        "amplification", F.when(F.col("bytes_flushed") > 0, (F.col("bytes_flushed") + F.col("bytes_written")) / F.col("bytes_flushed")).otherwise(0.0)
    )


def stats_rate(history: DataFrame) -> DataFrame:
    """Rate per second between polls (at_ms, total) of each counter: not below 0, the gap
    at least a millisecond."""
    w = Window.partitionBy("counter").orderBy("at_ms")
    gap = F.greatest(F.lit(1), F.col("at_ms") - F.lag("at_ms").over(w))
    return history.withColumn("rate", F.greatest(F.lit(0.0), (F.col("total") - F.lag("total").over(w)) * 1000.0 / gap))


def comparison(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("STCS", "LCS")) -> DataFrame:
    """Two one-row frames of equal columns, side by side: (metric, first, second)."""
    cols = [c for c in a.columns if c in b.columns]
    one = lambda df, n: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(n)) for c in cols])).alias("s")).select("s.*")
    return one(a, names[0]).join(one(b, names[1]), "metric")
