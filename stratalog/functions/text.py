"""Small renderings of numbers and query strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tenths(n: Column, unit: int, mark: str) -> Column:
    """n in units to one decimal, halves up, in whole numbers throughout."""
    tenths = F.floor((n * 10 + unit // 2) / unit).cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(mark))


def abbreviated(n: Column) -> Column:
    """A count as 999, 1.0K or 1.0M."""
    return F.when(n >= 1_000_000, _tenths(n, 1_000_000, "M")).when(n >= 1_000, _tenths(n, 1_000, "K")).otherwise(n.cast("string"))


def abbreviated_bytes(n: Column) -> Column:
    """A size as 999 B, 1.0 KB or 1.0 MB."""
    return F.when(n >= 1 << 20, _tenths(n, 1 << 20, " MB")).when(n >= 1 << 10, _tenths(n, 1 << 10, " KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def query_parameters(query: Column) -> Column:
    """A map of the decoded parameters of a query string; parts without = are passed over
    and the last of equal names counts. A null or blank one has none."""
    parts = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: F.instr(p, "=") > 0)
    pairs = F.transform(parts, lambda p: F.struct(F.url_decode(F.substring_index(p, "=", 1)).alias("name"), F.url_decode(F.substr(p, F.instr(p, "=") + F.lit(1))).alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    last = F.transform(names, lambda n: F.struct(n, F.element_at(F.filter(pairs, lambda p: p["name"] == n), -1)["value"]))
    return F.map_from_entries(last)
