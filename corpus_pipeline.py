"""A corpus pipeline of five of the operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. A stage that begins on sf_dir thus shows
that the results of the stages before it are written, so it deletes their scratch tables,
and no others.

Nulls and repeats, for all stages: a null text counts as empty and is passed on as null; a
null doc_id sorts after all others, and such rows are judged like any; rows that share a
doc_id are judged each by its own text. Empty tables stay empty; further columns of any
name are carried along, in order.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import Scratch, delete, empty_text, scratch, scratch_path
from stratalog.llm.decontaminate import contaminated
from stratalog.llm.jaccard_join import jaccard_join
from stratalog.llm.line_dedup import line_dedup
from stratalog.llm.sentencepiece_trie import encode
from stratalog.llm.toxicity import accepted

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_MADE: dict[str, list[tuple[int, Scratch]]] = defaultdict(list)


def _stage(place: int) -> Callable[[Stage], Stage]:
    """A stage in its place: the scratch tables of earlier places go, its own are noted."""

    def wrap(stage: Stage) -> Stage:
        @wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            for at, made in _MADE[sf_dir]:
                if at < place:
                    made.delete()
            with scratch(spark) as made:
                out = stage(spark, docs, sf_dir)
            _MADE[sf_dir] = [m for m in _MADE[sf_dir] if m[1].paths] + [(place, made)]
            return out

        return run

    return wrap


def _keyed(docs: DataFrame) -> DataFrame:
    """docs as a struct `row`, with a key of the text in place of other names."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", F.xxhash64(empty_text("row.text")).alias("key"))


@_stage(0)
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage(1)
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; every document stays."""
    return line_dedup(docs, least_tokens=1).select("row.*")


@_stage(2)
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest doc_id stays; of
    rows that share this doc_id the one with the smallest text key, once. Documents
    without words are alone and stay."""
    found = jaccard_join(docs).where("component_key is not null").select("component_key", "doc_id", "text_key")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("text_key").alias("key"))
    first = found.groupBy("component_key").agg(F.min(place).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    several = found.join(first, "component_key").select("doc_id", F.col("text_key").alias("key"), F.col("first").eqNullSafe(place).alias("stays"))
    gone = several.where("not stays").select(F.col("doc_id").alias("d"), "key").distinct()
    rows = _keyed(docs)
    left = rows.join(gone, (F.col("row.doc_id").cast("long").eqNullSafe(F.col("d"))) & (rows["key"] == gone["key"]), "left_anti")
    # A row that is repeated whole stays once.
    again = several.where("stays").groupBy(F.col("doc_id").alias("d"), "key").agg(F.count("*").alias("times")).where("times > 1").select("d", "key")
    same = (F.col("row.doc_id").cast("long").eqNullSafe(F.col("d"))) & (left["key"] == again["key"])
    once = left.join(again, same, "left_semi").groupBy(F.col("row.doc_id"), "key").agg(F.first("row").alias("row")).select("row", "key")
    return left.join(again, same, "left_anti").unionByName(once).select("row.*")


@_stage(3)
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, each judged by its text."""
    rows = _keyed(docs)
    leaks = contaminated(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(leaks.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")


@_stage(4)
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as token ids."""
    return encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("sentencepiece", tokenize),
]

#: The stages' models and searches are beyond SQL; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result, lazy. The table of a stage goes once the next one is
    written; the last one is read by the result and goes with the scope around run()."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                delete(spark, before)
            before = path
    return docs
