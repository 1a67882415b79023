"""Between wide rows and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import TOMBSTONE


def cells_from_wide(wide: DataFrame, key: Column, columns: list[str], ts: Column, seq: Column) -> DataFrame:
    """One live cell for each column that is not null."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
    cells = wide.select(key.alias("key"), ts.alias("ts"), seq.alias("seq"), F.explode(pairs).alias("c")).where("c.value is not null")
    return cells.select("key", "c.name", "c.value", "ts", F.lit(0).alias("flags"), F.lit(0).alias("ttl"), "seq")


def tombstones(keys: DataFrame, ts: Column, seq: Column) -> DataFrame:
    """Deletes of (key, name)."""
    return keys.select("key", "name", F.lit(None).cast("string").alias("value"), ts.alias("ts"), F.lit(TOMBSTONE).alias("flags"), F.lit(0).alias("ttl"), seq.alias("seq"))


def assembled(cells: DataFrame) -> DataFrame:
    """Wide rows: (key, cells), cells sorted by name."""
    cell = F.struct("name", "value", "ts", "flags", "ttl")
    return cells.groupBy("key").agg(F.sort_array(F.collect_list(cell)).alias("cells"))


def row_json(cells: DataFrame) -> DataFrame:
    """(key, json): names in order, a tombstone as null with its flag."""
    body = F.transform("cells", lambda c: F.struct(c["name"], c["value"], c["ts"], (c["flags"].bitwiseAND(TOMBSTONE) != 0).alias("tombstone")))
    return assembled(cells).select("key", F.to_json(F.struct("key", body.alias("cells")), {"ignoreNullFields": "false"}).alias("json"))


def blast(spark, n: int) -> DataFrame:
    """n rows of generated load."""
    ids = spark.range(n)
    return ids.select(F.concat(F.lit("user:"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("key"), F.lit("email").alias("name"), F.concat(F.lit("user"), F.col("id").cast("string"), F.lit("@example.org")).alias("value"))
