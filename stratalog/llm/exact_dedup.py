"""Exact deduplication by skew-safe combining.

Three stages, all comparing full texts: Spark's map-side aggregation combines equal texts
inside each task, salted digest groups combine them per salt, and the salt winners are
combined globally. A text held by a third of all rows therefore reaches the salted stage
as one row per task and the global one as one row per salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, text_rows, written

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the
    row with the largest doc_id stays. A null doc_id is smaller than any other; where all
    are null, or rows are repeated with the same id, each row that equals the winner is
    kept. An empty table gives an empty result; other columns are not read. Equal digests
    of different texts (any digest function may be given) don't merge.
    """
    rows = text_rows(docs).select("doc_id", "text", digest(F.col("text")).alias("digest"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts))
    salted = rows.groupBy("digest", salt.alias("salt"), "text").agg(F.max("doc_id").alias("best"), F.count("*").alias("n"))
    winners = salted.groupBy("digest", "text").agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size"))
    groups = winners.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts"))
    several = written(groups.where("group_size > 1"), "exact-groups")
    # Rows whose digest no other row has need no partner; those of the others are dealt out.
    alone = F.col("texts").isNull()
    out = looked_up(rows, several, "digest", "doc_id").where("texts is null or texts = 1").select(
        "doc_id", "digest", "text", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(alone, 1).otherwise(F.col("group_size")).cast("long").alias("group_size"),
    )
    if several.where("texts > 1").take(1):  # different texts with one digest are told apart by the text
        clashing, content = several.where("texts > 1").select("digest"), F.struct("digest", "text").alias("content")
        best = winners.join(clashing, "digest", "left_semi").select(content, "keep_id", "group_size")
        out = out.unionByName(looked_up(rows.join(clashing, "digest", "left_semi").select("*", content), best, "content", "doc_id").select(*out.columns))
    return out.select(
        "doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"),
        (F.col("digest") if digest is sha256 else sha256(F.col("text"))).alias("text_sha256"),
    )
