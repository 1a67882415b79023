"""URL filters by redirect equivalence.

Rules judge the URLs that they fit. Redirect and canonical-link edges join URLs into
components; a URL without a rule of its own takes the decision of its component: blocked
if an alias is blocked, unless an alias is expressly allowed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from html import unescape as html_unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, components, lean, written


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that are tested in one expression; longer lists are joined on host suffixes.
INLINE_RULES = 64


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ://."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    after = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise("")
    return F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def _best(rules: Sequence[Rule]) -> list[Rule]:
    """Longest first; of equally long ones, allow first."""
    return sorted(rules, key=lambda r: (-len(r.name), r.verdict, r.name))


def with_rule(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add rule and ruling (both null without a fitting rule) to rows with host and path."""
    if len(rules) <= INLINE_RULES:
        name = ruling = F.lit(None).cast("string")
        for r in reversed(_best(rules)):
            fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
            name, ruling = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(ruling)
        return pages.withColumns({"rule": name, "ruling": ruling})
    spark = pages.sparkSession
    listed = spark.createDataFrame([(r.host, r.path, r.name, r.verdict, i) for i, r in enumerate(_best(rules))], "rule_host string, rule_path string, rule string, ruling string, place int")
    urls = pages.select("host", "path").distinct()
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    fits = urls.select("host", "path", F.explode(suffixes).alias("rule_host")).join(listed, "rule_host").where("startswith(path, rule_path)")
    best = fits.groupBy("host", "path").agg(F.min_by(F.struct("rule", "ruling"), "place").alias("r")).select("host", "path", "r.rule", "r.ruling")
    return pages.join(best, ["host", "path"], "left")


def _key(url: Column) -> Column:
    """A node of the graph: the digest of a URL without its fragment."""
    return F.unhex(F.md5(F.regexp_replace(url, "#.*$", "").cast("binary")))


def resolved(base: str, target: str) -> str | None:
    """The URL that an attribute's target names on the page base (RFC 3986, 5.2); none
    without a scheme and ://. Entities are decoded first."""
    target = html_unescape(target).strip()
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", target):
        return target if "://" in target else None
    whole = re.match(r"([^/?#]*:)//([^/?#]*)([^?#]*)(\?[^#]*)?", base)
    if not whole:
        return None
    scheme, host, path, query = whole[1], whole[2], whole[3], whole[4] or ""
    if target.startswith("//"):
        return scheme + target
    to, after, rest = re.match(r"([^?#]*)(\?[^#]*)?(.*)", target, re.DOTALL).groups()
    if not to:
        return f"{scheme}//{host}{path}{query if after is None else after}{rest}"
    parts = (to if to.startswith("/") else path.rpartition("/")[0] + "/" + to).split("/")[1:]
    kept: list[str] = []
    for p in parts:
        if p == "..":
            kept = kept[:-1]
        elif p != ".":
            kept.append(p)
    if parts[-1] in (".", ".."):
        kept.append("")
    return f"{scheme}//{host}/{'/'.join(kept)}{after or ''}{rest}"


@lean
def _resolved(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows:
        src, dst = (c.to_pylist() for c in b.columns)
        yield batches({"src": (src, pa.string()), "dst": ([resolved(s, d) for s, d in zip(src, dst, strict=True)], pa.string())})


def html_edges(pages: DataFrame, relative: bool = False) -> DataFrame:
    """(src, dst) urls of canonical links and refresh redirects in the html, resolved
    against the page's url. Targets relative to the document are left out unless asked for."""
    tag = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
    href = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", r"(?is)\burl\s*=\s*[\"']?((?:&#?\w+;|[^\"'\s>;])+)"
    html = F.coalesce(F.col("html"), F.lit(""))

    def attribute(pattern: str) -> Callable[[Column], Column]:
        return lambda found: F.regexp_extract(found, pattern, 1)

    targets = [F.transform(F.regexp_extract_all(html, F.lit(t), F.lit(0)), attribute(h)) for t, h in zip(tag, href, strict=True)]
    found = pages.where(F.col("url").isNotNull() & F.lower(html).rlike("canonical|refresh")).select(F.col("url").alias("src"), F.explode(F.concat(*targets)).alias("dst"))
    found = found.where("dst <> ''")
    if not relative:
        found = found.where(F.col("dst").startswith("/") | (F.instr("dst", "://") > 0))
    return found.mapInArrow(_resolved, "src string, dst string").where(F.col("dst").isNotNull())


def url_filter(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of pages(page_id, url, html).

    A rule fits its host and all subdomains where the path starts with the rule's; the
    longest wins, allow before block. redirects(src, dst) adds edges to those found in
    the html. A url without a rule is blocked if its component holds a url blocked by
    rule, be it a page or only the target of a link, and none allowed by rule; else it is
    allowed. A null url, or one without ://, has empty host and path and fits no rule.
    Repeated rows are judged alike; an empty table gives none; other columns are not read.
    """
    pages = pages.select("page_id", "url", "html")
    host, path = url_parts(F.col("url"))
    judged = with_rule(pages.select("page_id", _key(F.col("url")).alias("node"), host.alias("host"), path.alias("path")), rules)
    edges = html_edges(pages, relative=True)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst").dropna())
    edges = written(edges.distinct(), "url-edges")
    plain = ["page_id", "host", "path", "rule"]
    if not edges.take(1):
        return judged.select(*plain, F.coalesce("ruling", F.lit("allow")).alias("verdict"))
    members = components(edges.select(_key(F.col("src")).alias("a"), _key(F.col("dst")).alias("b")))
    urls = edges.select(F.explode(F.array("src", "dst")).alias("url")).distinct()
    ends = with_rule(urls.select(_key(F.col("url")).alias("node"), *[c.alias(n) for c, n in zip(url_parts(F.col("url")), ("host", "path"), strict=True)]), rules)
    by_component = (
        ends.join(members, "node").groupBy("component")
        .agg(F.max(F.coalesce(F.col("ruling") == "block", F.lit(False))).alias("blocked"), F.max(F.coalesce(F.col("ruling") == "allow", F.lit(False))).alias("allowed"))
        .where("blocked and not allowed").select("component", F.lit("block").alias("passed"))
    )
    by_node = members.join(by_component, "component").select("node", "passed")
    return judged.join(by_node, "node", "left").select(*plain, F.coalesce("ruling", "passed", F.lit("allow")).alias("verdict"))
