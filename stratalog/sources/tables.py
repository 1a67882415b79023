"""The given tables as cell logs.

`mutations` reads each event as a write, some of them deletes or expiring. Sixteen slices
of the arrival order are memory tables: the last is active, the one before is being
flushed, the four before those are level-0 files. Older ones are compacted into four
token ranges on each of levels 1 and 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tokens import with_token
from ..operators.catalog import statistics
from ..operators.reconcile import memtable_merge

SEGMENTS, SLICES, ACTIVE, FLUSHING, L1_FROM, L0_FROM = 8, 16, 15, 14, 5, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def mutations(spark: SparkSession, sf_dir: str, tied: bool = False) -> DataFrame:
    """tied: timestamps cut to the day, so that the tie rules decide."""
    events = table(spark, sf_dir, "events")
    n = events.count()  # from the files' footers
    ts = micros("date_trunc('DAY', ts)") if tied else micros("ts")
    i = F.col("event_id")
    flags = F.when(i % 10 == 9, 1).when(i % 7 == 0, 2).otherwise(0)
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    return events.select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"), F.col("event_type").alias("name"),
        F.when(i % 10 == 9, None).otherwise(cents).alias("value"), ts.alias("ts"), flags.alias("flags"), F.when(flags == 2, 432_000).otherwise(0).alias("ttl"),
        i.alias("seq"), F.expr(f"event_id * {SEGMENTS} div {n}").alias("segment_id"), F.expr(f"event_id * {SLICES} div {n}").alias("generation"), (i % 997 == 996).alias("bad_crc"),
    )


def memory(cells: DataFrame) -> DataFrame:
    """The two memory tables, merged, with tier 0 (active) or 1."""
    recent = cells.where(F.col("generation") >= FLUSHING).withColumn("tier", F.when(F.col("generation") == ACTIVE, 0).otherwise(1))
    return memtable_merge(recent, ("tier", "key", "name"))


def file_cells(cells: DataFrame) -> DataFrame:
    """Cells of every file: (file_id, level, token, key, name, ...)."""
    old = with_token(cells.where(F.col("generation") < FLUSHING))
    level = F.when(F.col("generation") >= L0_FROM, 0).when(F.col("generation") >= L1_FROM, 1).otherwise(2)
    quarter = F.shiftright("token", 62) + 2
    file = F.when(F.col("generation") >= L0_FROM, F.col("generation")).otherwise(F.when(F.col("generation") >= L1_FROM, 100).otherwise(200) + quarter)
    placed = old.withColumn("level", level).withColumn("file_id", file.cast("long"))
    return memtable_merge(placed, ("file_id", "level", "token", "key", "name"))


def catalog(files: DataFrame) -> DataFrame:
    """Statistics with positions, newest file (by id) first."""
    place = F.row_number().over(Window.orderBy(F.desc("file_id"))) - 1
    return statistics(files).withColumn("catalog_pos", place)


def keys(cells: DataFrame) -> DataFrame:
    return with_token(cells.select("key").distinct())


def lineitem_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as cells. (order, line) repeats, so seq breaks ties over all columns."""
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return li.select(
        F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("key"), F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("name"),
        F.col("l_quantity").cast("long").cast("string").alias("value"), micros("l_shipdate").alias("ts"), F.lit(0).alias("flags"), F.lit(0).alias("ttl"), F.row_number().over(order).cast("long").alias("seq"),
    )
