"""Predicates and renderings of a cell. `now` (microseconds) is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EXPIRING, TOMBSTONE


def is_tombstone() -> Column:
    return F.col("flags").bitwiseAND(TOMBSTONE) != 0


def is_expiring() -> Column:
    return F.col("flags").bitwiseAND(EXPIRING) != 0


def is_expired(now: int) -> Column:
    return is_expiring() & (F.lit(now) > F.col("ts") + F.col("ttl").cast("long") * 1_000_000)


def is_live(now: int) -> Column:
    return ~is_tombstone() & ~is_expired(now)


def is_purgeable(now: int, grace_seconds: int) -> Column:
    return is_tombstone() & (F.lit(now) > F.col("ts") + F.lit(grace_seconds * 1_000_000))


def rendered() -> Column:
    return F.when(is_tombstone(), "<tombstone>").otherwise(F.col("value"))


def cell_bytes() -> Column:
    """Encoded size of one cell inside a record."""
    return (F.octet_length("name") + F.coalesce(F.octet_length("value"), F.lit(0)) + 19).cast("long")


def record_bytes(key: str = "key") -> Column:
    """Encoded size of a record: an aggregate over the cells of a key."""
    return F.sum(cell_bytes()) + F.max(F.octet_length(key)) + 4


def memory_bytes() -> Column:
    """What a put of one cell adds to the estimate of a memory table. Two bytes for each
    UTF-16 unit of the name."""
    units = F.octet_length(F.encode("name", "UTF-16BE"))
    return (F.octet_length("key") + 16 + units + F.coalesce(F.octet_length("value"), F.lit(0)) + 32).cast("long")
