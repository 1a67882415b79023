"""Last-write-wins in its variants.

Within a memory table the later arrival wins a tie of timestamps; in a compaction the
earlier input. Both are one aggregation with map-side combining (by sorting, as a cell holds
a string) and no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as c
from .catalog import bin_of, binned

CELL = ("value", "ts", "flags", "ttl", "seq")


def _winner(cells: DataFrame, order: Column, by: tuple[str, ...]) -> DataFrame:
    present = [x for x in CELL if x in cells.columns]
    best = cells.groupBy(*by).agg(F.max_by(F.struct(*present), order).alias("cell"))
    return best.select(*by, *[f"cell.{x}" for x in present])


def memtable_merge(cells: DataFrame, by: tuple[str, ...] = ("key", "name")) -> DataFrame:
    return _winner(cells, F.struct("ts", "seq"), by)


def compaction_merge(cells: DataFrame, position: str = "input_pos", by: tuple[str, ...] = ("key", "name")) -> DataFrame:
    """position: of the cell's file among the inputs. Inside one file a key's cell is
    unique."""
    return _winner(cells, F.struct(F.col("ts"), -F.col(position)), by)


def purge(cells: DataFrame, now: int, grace_seconds: int = 0) -> DataFrame:
    """Drop purgeable tombstones and expired cells; after the merge, never before."""
    return cells.where(~(c.is_purgeable(now, grace_seconds) | c.is_expired(now)))


def purge_safe(cells: DataFrame, outside: DataFrame, now: int, grace_seconds: int = 0) -> DataFrame:
    """As purge, but a tombstone stays while a file outside the plan (min_token, max_token)
    may hold its key: deleted data can't come back. Only the tokens of purgeable tombstones
    are looked for, by bin."""
    gone = c.is_purgeable(now, grace_seconds)
    ranges = binned(outside.select("min_token", "max_token")).withColumnRenamed("bin", "_bin")
    inside = F.col("min_token").isNull() | F.col("max_token").isNull() | F.col("token").between(F.col("min_token"), F.col("max_token"))
    held = cells.where(gone).select("token").distinct().join(ranges, (bin_of() == F.col("_bin")) & inside, "left_semi")
    kept = cells.where(~c.is_expired(now))
    return kept.where(~gone).unionByName(kept.where(gone).join(held, "token", "left_semi").select(*cells.columns))


def purged(before: DataFrame, now: int, grace_seconds: int = 0) -> DataFrame:
    """One row: cells purged, and rows that became empty."""
    gone = c.is_purgeable(now, grace_seconds) | c.is_expired(now)
    rows = before.groupBy("key").agg(F.count("*").alias("cells"), F.sum(gone.cast("long")).alias("gone"))
    return rows.agg(F.coalesce(F.sum("gone"), F.lit(0)).alias("cells_purged"), F.coalesce(F.sum((F.col("cells") == F.col("gone")).cast("long")), F.lit(0)).alias("rows_emptied"))
