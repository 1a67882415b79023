import random

import pytest
from brute import closure
from stratalog.llm import url_filter as uf
from stratalog.llm.queries import RULES

SCHEMA = "page_id long, url string, html string, host string, rule string, node string"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def rule_of(url, rules):
    host, path = parts(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return min(fits, key=lambda r: (-len(r.name), r.verdict), default=None)


def plain(rows, rules, edges=()):
    node = lambda u: u.split("#")[0]
    low = closure([(node(a), node(b)) for a, b in edges if node(a) != node(b)])
    block, allow = set(), set()
    for n, c in low.items():
        if r := rule_of(n, rules):
            (block if r.verdict == "block" else allow).add(c)
    out = []
    for p, u, _ in rows:
        r, c = rule_of(u, rules), low.get(node(u or ""))
        verdict = r.verdict if r else "block" if c in block - allow else "allow"
        out.append((p, *parts(u), r.name if r else None, verdict))
    return sorted(out, key=str)


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "h", "r", "n") for r in rows], SCHEMA)


URLS = [None, "", "no scheme", "http://", "http://X.COM", "http://x.com/", "https://com/en/", "http://example.com/en/a?b#c", "http://EXAMPLE.com/en", "http://www.example.com/en/x", "http://a.www.example.com/en/", "http://notexample.com/en/", "x://b.net/es/#f", "x://b.net/fr/?q", "x://net/de/", "a://b://c.net/es/", "http://É.Net/es/é", "http://user@x.net:80/fr/"]


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("inline", [64, 0])
def test_rules(pages, monkeypatch, inline):
    monkeypatch.setattr(uf, "INLINE_RULES", inline)
    rows = [(i, u, None) for i, u in enumerate(URLS + URLS[:3])]
    assert got(uf.url_filter(pages(rows), RULES)) == plain(rows, RULES)
    assert uf.url_filter(pages([]), RULES).count() == 0


def test_decisions_pass_over_edges(spark, pages):
    rng = random.Random(1)
    urls = [f"http://{h}/{p}/{i}" for i in range(12) for h in ("a.org", "b.net") for p in ("es", "en")] + ["http://x.com/1", "http://y.com/2"]
    edges = [(rng.choice(urls), rng.choice(urls)) for _ in range(25)] + [("http://a.org/lone", "http://only.a.target.net/es/")]
    rows = [(i, u + rng.choice(["", "#f"]), None) for i, u in enumerate([*urls, "http://a.org/lone"])]
    out = uf.url_filter(pages(rows), RULES, spark.createDataFrame([*edges, (None, "x")], "src string, dst string"))
    assert got(out) == plain(rows, RULES, edges)
    assert {r.verdict for r in out.where("rule is null").collect()} == {"allow", "block"}


def test_edges_in_html(pages):
    rows = [
        (1, "http://a.org/x", '<LINK href=/y REL="canonical">'),
        (2, "http://b.org/", "<meta http-equiv='refresh' content='0; URL=http://c.net/es/'>"),
        (3, "http://c.org/", '<link rel=stylesheet href="http://d.net/es/"> canonical'),
        (4, None, "<link rel=canonical href='http://z/'>"),
        (5, "http://e.org/", "<link rel=canonical href='relative'>"),
    ]
    assert got(uf.html_edges(pages(rows))) == [("http://a.org/x", "http://a.org/y"), ("http://b.org/", "http://c.net/es/")]
    assert [r.verdict for r in uf.url_filter(pages(rows), RULES).orderBy("page_id").collect()] == ["allow", "block", "allow", "allow", "allow"]


def test_table(table):
    rows = [(r.page_id, r.url, None) for r in table("pages").collect()]
    assert got(uf.url_filter(table("pages"), RULES)) == plain(rows, RULES)


def test_targets_are_resolved():
    base = "http://a.org/b/c/d;p?q"
    # RFC 3986, 5.4; targets with a scheme of their own and no authority name no url here.
    want = {"g": "b/c/g", "./g": "b/c/g", "g/": "b/c/g/", "/g": "g", "?y": "b/c/d;p?y", "g?y": "b/c/g?y", "#s": "b/c/d;p?q#s", "g#s": "b/c/g#s", ";x": "b/c/;x", "": "b/c/d;p?q", ".": "b/c/", "./": "b/c/", "..": "b/", "../": "b/", "../g": "b/g", "../..": "", "../../g": "g", "../../../g": "g", "/./g": "g", "/../g": "g", "g.": "b/c/g.", "..g": "b/c/..g", "./g/.": "b/c/g/", "g/../h": "b/c/h", "g?y/../x": "b/c/g?y/../x", "g?u=http://x": "b/c/g?u=http://x"}
    assert {t: uf.resolved(base, t) for t in want} == {t: "http://a.org/" + w for t, w in want.items()}
    assert uf.resolved(base, "//g.net/es/") == "http://g.net/es/" and uf.resolved("http://a.org", "g") == "http://a.org/g"
    assert uf.resolved(base, "/x?a=1&amp;b=2") == "http://a.org/x?a=1&b=2" and uf.resolved(base, "mailto:x@y") is None


def test_aliases_by_relative_targets_are_blocked(spark, pages):
    rows = [
        (1, "http://b.org/x/1", "<link rel=canonical href='page.html'>"),
        (2, "http://b.org/x/2", "<link rel=canonical href='../y?a=1&amp;b=2'>"),
        (3, "http://b.org/x/3", "<link rel=canonical href='//c.net/es/'>"),
        (4, "http://b.org/x/page.html", "<meta http-equiv=refresh content='0; url=//c.net/fr/'>"),
        (5, "http://b.org/y?a=1&b=2", "<link rel=canonical href='http://d.net/es/?a&amp;b'>"),
        (6, "http://b.org/x/6", "<link rel=canonical href='other.html'>"),
        (7, "http://b.org/x/7", "<meta http-equiv=refresh content='0; url=/z?a=1&amp;b=2'>"),
        (8, "http://b.org/z?a=1&b=2", "<link rel=canonical href='http://d.net/es/'>"),
    ]
    out = {r.page_id: r.verdict for r in uf.url_filter(pages(rows), RULES).collect()}
    assert out == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "block", 8: "block"}
