"""The operators applied to whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_join
from .line_dedup import line_dedup
from .secret_scan import secret_scan
from .sentencepiece_trie import encode
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity
from .url_filter import Rule, url_filter
from .warc import warc_round_trip

# The rules of op6.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"), least_tokens=1)
    return out.select("row.doc_id", "row.text", "n_lines", "n_dropped")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), RULES)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_warc, op2_decontamination, op3_jaccard_join, op4_toxicity, op5_line_dedup,
        op6_url_filter, op7_sentencepiece, op8_exact_dedup, op9_suffix_dedup, op10_secret_scan,
    )
    return {f.__name__: f for f in every}


_RULING = "\n".join(
    f"              WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.verdict}|{r.name}'"
    for r in sorted(RULES, key=lambda r: -len(r.name))
)


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
            q AS (SELECT page_id, html, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
            SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
                   array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
                   CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id <> first THEN first END AS refers_to
            FROM q""",
        # The pages of the given tables hold no redirects or canonical links, so no page
        # takes a decision from an alias; tests cover those.
        "op6_url_filter": rf"""
            WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
            v AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
            w AS (SELECT page_id, host, path, CASE
{_RULING}
              END AS r FROM v)
            SELECT page_id, host, path, split_part(r, '|', 2) AS rule, coalesce(split_part(r, '|', 1), 'allow') AS verdict FROM w""",
        "op8_exact_dedup": """
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
            FROM (SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, sha256(t) AS text_sha256
                  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
                  WINDOW w AS (PARTITION BY t))""",
    }
