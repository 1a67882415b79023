import random

import numpy as np
from brute import closure, jaccard, shingles
from stratalog.llm import jaccard_join as jj
from stratalog.llm.common import components, shingle_set

COLS = ("doc_id", "n_shingles", "component_id", "n_links")


def got(df):
    return sorted(map(tuple, df.select(*COLS).collect()))


def near_copies(seed=3, groups=14):
    rng, rows, d = random.Random(seed), [], 0
    common = [f"c{i}" for i in range(60)]
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([4, 6, 30, 120, 300]))]
        if g % 3 == 0:
            base[2:2] = common
        for _ in range(rng.choice([1, 2, 3, 9])):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 25)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(999)}"
            words = words[: rng.randrange(len(words) * 4 // 5, len(words)) + 1]
            rows.append((d, " ".join(words)))
            d += rng.randrange(1, 3)
    rng.shuffle(rows)
    return rows


def test_edges_of_a_link(docs):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one two"), (6, "ONE\x0btwo"), (7, "a b c d e f g h"), (8, "a b c d e f g"), (9, "a b c d e f"), (9, "a b c d e f")]
    assert got(jj.jaccard_join(docs(rows))) == jaccard(rows)
    assert jj.jaccard_join(docs([])).count() == 0
    assert jj.jaccard_join(docs([(None, "a b c"), (3, "a b c"), (None, None)])).count() == 3


def test_near_copies(docs):
    rows = near_copies()
    assert got(jj.jaccard_join(docs(rows))) == jaccard(rows)


def test_chunks_of_a_large_group(docs, monkeypatch):
    monkeypatch.setattr(jj, "CHUNK_CLASSES", 3)
    rows = near_copies(seed=5, groups=9)
    assert got(jj.jaccard_join(docs(rows))) == jaccard(rows)


def test_a_shingle_that_all_share(docs, monkeypatch):
    """One passage in every document, in bands of sizes, and no link for it alone."""
    monkeypatch.setattr(jj, "CHUNK_CLASSES", 4)
    rng, rows = random.Random(8), []
    for d in range(60):
        own = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 10, 14, 19, 40, 60, 90]))]
        rows.append((d, " ".join(["this passage is in every text", *own])))
        if d % 3 == 0:
            rows.append((100 + d, rows[-1][1] + " end"))
    assert got(jj.jaccard_join(docs(rows))) == jaccard(rows)


def test_table(table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    assert got(jj.jaccard_join(table("documents"))) == jaccard(rows)


def test_shingle_sets():
    for text in ("", " ", "a", "a b c d", "a b c d e", "the of the of the of the of", "x  y\r\nz\x0c q r s\x1cr"):
        assert len(shingle_set(text.encode().lower())) == len(shingles(text))


def test_tree_loses_no_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(400) < 0.93], rng.integers(0, 2**63, 20, dtype=np.uint64)])) for _ in range(150)]
    every = np.arange(len(sets))
    found = {int(q): set(near.tolist()) for q, near in jj.links(sets, every, every)}
    for q in every:
        want = {int(x) for x in every if x != q and 100 * (k := len(np.intersect1d(sets[q], sets[x]))) >= 75 * (len(sets[q]) + len(sets[x]) - k)}
        assert found.get(int(q), set()) == want


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    want = closure([p for p in pairs if p[0] != p[1]])
    for few in (1000, 60, 0):
        assert {r.node: r.component for r in components(edges, one_task_edges=few).collect()} == want
