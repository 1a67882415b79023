"""Bloom filters as bit tables: (file_id, bit), one row per set bit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import bloom_size_columns, with_bloom_positions
from ..model import BLOOM_FPP


def sizes(file_keys: DataFrame, fpp: float = BLOOM_FPP) -> DataFrame:
    """(file_id, keys, bits, hashes) for (file_id, token) rows, one per key."""
    n = file_keys.groupBy("file_id").agg(F.count("*").alias("keys"))
    bits, hashes = bloom_size_columns(F.col("keys"), fpp)
    return n.withColumn("bits", bits).withColumn("hashes", hashes)


def build(file_keys: DataFrame, fpp: float = BLOOM_FPP) -> DataFrame:
    sized = with_bloom_positions(file_keys.join(sizes(file_keys, fpp), "file_id"))
    return sized.select("file_id", F.explode("positions").alias("bit")).distinct()


def probe(keys: DataFrame, file_keys: DataFrame, fpp: float = BLOOM_FPP) -> DataFrame:
    """(file_id, key, might_contain) for every row of keys(file_id, token, key). A file
    without a filter lets everything pass."""
    size = sizes(file_keys, fpp)
    asked = with_bloom_positions(keys.select("file_id", "token", "key").distinct().join(size, "file_id"))
    wanted = asked.select("file_id", "key", "hashes", F.explode(F.array_distinct("positions")).alias("bit"))
    hit = wanted.join(build(file_keys, fpp).withColumn("set", F.lit(1)), ["file_id", "bit"], "left")
    out = hit.groupBy("file_id", "key").agg((F.count("*") == F.count("set")).alias("might_contain"))
    return keys.select("file_id", "key").distinct().join(out, ["file_id", "key"], "left").select("file_id", "key", F.coalesce("might_contain", F.lit(True)).alias("might_contain"))


def memory_bytes(size: DataFrame) -> DataFrame:
    """What each filter takes: its bits in whole words of 64."""
    return size.withColumn("memory_bytes", F.expr("(bits + 63) div 64 * 8"))


def false_positive_rate(size: DataFrame) -> DataFrame:
    """The rate to expect at the present number of keys."""
    return size.withColumn("fpp", F.pow(1 - F.exp(-F.col("hashes") * F.col("keys") / F.col("bits")), F.col("hashes")))
