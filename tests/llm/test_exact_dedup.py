import hashlib
from collections import defaultdict

from pyspark.sql import functions as F
from stratalog.llm.exact_dedup import exact_dedup


def plain(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for d, t in rows:
        ids = groups[t or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "A"), (6, "x" * 200_000), (9, "x" * 200_000), (None, "a"), (None, "lone"), (2, "a"), (7, "é"), (8, "é")]


def test_cases(docs):
    assert sorted(map(tuple, exact_dedup(docs(ROWS)).collect()), key=str) == plain(ROWS)
    assert exact_dedup(docs([])).count() == 0


def test_colliding_digests_keep_texts_apart(docs):
    out = exact_dedup(docs(ROWS), digest=lambda t: F.length(t) % 2)
    assert sorted(map(tuple, out.collect()), key=str) == plain(ROWS)


def test_table(table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    assert sorted(map(tuple, exact_dedup(table("documents")).collect()), key=str) == plain(rows)
