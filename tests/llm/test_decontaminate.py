import random

import numpy as np
import pytest
from stratalog.llm import decontaminate as dc
from stratalog.llm.common import word_hashes


def lcs_plain(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs():
    rng = np.random.default_rng(3)
    for _ in range(100):
        a, b = (rng.integers(0, 5, rng.integers(0, 80)) for _ in range(2))
        assert dc.lcs(a, b) == lcs_plain(a.tolist(), b.tolist())


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def corpus(seed=2, docs=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(800)]
    say = lambda n: [vocabulary[min(799, int(rng.expovariate(1 / 150)))] for _ in range(n)]
    items = [(i, " ".join(say(rng.randrange(12, 55)))) for i in range(15)]
    rows, leaks = [], set()
    for d in range(docs):
        words = say(rng.randrange(0, 400))
        if d % 5 == 0:
            i = rng.randrange(len(items))
            leak = items[i][1].split()
            for k in range(0, len(leak), 9):  # a paraphrase
                leak[k] = rng.choice(vocabulary)
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," if d % 2 else w for w in leak]
            leaks.add((d, i))
        rows.append((d, " ".join(words)))
    return rows, items, leaks


def test_paraphrases_are_found_and_clean_documents_left(docs, items):
    rows, bench, leaks = corpus()
    found = {(r.doc_id, r.item_id) for r in dc.contaminated(docs(rows), items(bench)).collect()}
    assert len(found & leaks) >= 0.9 * len(leaks)
    assert {d for d, _ in found} <= {d for d, _ in leaks}


def test_cases(docs, items):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, None), (2, ""), (3, "Alpha beta, gamma delta epsilon zeta eta theta iota KAPPA."), (None, item), (3, "other"), (4, "few words here"), (5, ("filler " * 9000) + item), (6, "words few here")]
    bench = [(7, item), (7, item), (8, None), (9, ""), (10, "few words here"), (None, item)]
    found = {(r.doc_id, r.item_id) for r in dc.contaminated(docs(rows), items(bench)).collect()}
    assert found == {(3, 7), (None, 7), (5, 7), (3, None), (None, None), (5, None), (4, 10)}
    assert dc.contaminated(docs([]), items(bench)).count() == 0
    assert dc.contaminated(docs(rows), items([])).count() == 0


def test_blocks_agree(docs, items, monkeypatch):
    rows, bench, leaks = corpus()
    want = {(r.doc_id, r.item_id) for r in dc.contaminated(docs(rows), items(bench)).collect()}
    monkeypatch.setattr(dc, "BLOCK_PASSAGES", 4)
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(docs(rows), items(bench)).collect()} == want


def test_svd_is_that_of_the_matrix(spark):
    rng = np.random.default_rng(5)
    low = rng.standard_normal((60, 6)) @ rng.standard_normal((6, 40))
    rows = [(list(range(40)), r.tolist()) for r in low]
    v, s = dc.randomised_svd(spark.createDataFrame(rows, "at array<int>, value array<float>").repartition(3), rank=6)
    assert np.allclose(s, np.linalg.svd(low)[1][:6], rtol=1e-3)
    assert np.allclose(low @ v[:40] @ v[:40].T, low, atol=1e-2)


def found_plainly(words, passage):
    """Whether some stretch of a text has the shares of a passage, trying every one."""
    m, wanted = len(passage), set(passage)
    reach = m + m // 4
    inside = np.concatenate(([0], np.cumsum([w in wanted for w in words])))
    least, tail = -(-3 * m // 4), passage[-max(4, m // 4) :]
    for s in range(max(1, len(words) - m + 1)):
        part = words[s : s + reach]
        if inside[s + len(part)] - inside[s] >= least and lcs_plain(passage, part) >= 0.75 * m and lcs_plain(tail, part) >= 0.5 * len(tail):
            return True
    return False


def test_findings_against_brute_force(table, docs):
    """Recall of paraphrases in the given table: every text against every passage."""
    rng, bench = random.Random(4), table("benchmark")
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    items, vocabulary = [r.text for r in bench.orderBy("item_id").collect()], sorted({w for _, t in rows for w in (t or "").split()})
    for k in range(0, len(rows), 4):  # plant paraphrases: words replaced, left out and put in
        words = []
        for w in rng.choice(items).split():
            words += rng.choices([[w], [rng.choice(vocabulary)], [], [w, rng.choice(vocabulary)]], [20, 1, 1, 1])[0]
        text = (rows[k][1] or "").split()
        at = rng.randrange(len(text) + 1)
        rows[k] = (rows[k][0], " ".join(text[:at] + words + text[at:]))
    found = {(r.doc_id, r.item_id) for r in dc.contaminated(docs(rows), bench).collect()}
    plain = lambda t: dc.plain(t or "").split()
    passages = [(r.item_id, p.tolist()) for r in bench.collect() for p in np.array_split(np.array(plain(r.text), object), -(-len(plain(r.text)) // dc.PASSAGE_WORDS))]
    want = {(d, i) for d, t in rows for words in [plain(t)] for i, p in passages if len(p) >= dc.SHORT and found_plainly(words, p)}
    assert len(want) > len(rows) // 8
    assert len(found & want) >= 0.95 * len(want)
    assert len(found - want) <= 0.05 * len(found)  # stretches longer than those tried here


def test_texts_together_and_alone_agree(docs):
    """Texts of a batch share running sums; none may see its neighbours."""
    rows, bench, _ = corpus(docs=40)
    passages = dc.passages_of(bench)
    idf, basis = dc.fit(dc.text_rows(docs(rows)), passages)
    block, texts = dc.Block(passages, idf, basis), [t for _, t in rows] + ["", "\n \t", "of " * 90_000 + bench[0][1] + " and" * 70_000]
    together = [(f[0], f[1], round(f[2], 3), *f[3:]) for f in block.findings(texts)]
    assert together == [(k, f[1], round(f[2], 3), *f[3:]) for k, t in enumerate(texts) for f in block.findings([t])]
    assert any(f[0] == len(texts) - 1 for f in together)
    assert (word_hashes(dc.plain(texts[-1]))[:3] == word_hashes(b"of of of")).all()


def test_space_is_that_of_all_texts_and_passages(docs, monkeypatch):
    """Not of a sample: the space takes in as much of all unit vectors as their SVD does."""
    monkeypatch.setattr(dc, "HELD_PIECES", 1, raising=False)
    rows, bench, _ = corpus(docs=400)
    rows += [(1000, ""), (1001, None), (1002, "!"), (1003, "only here " * 300)]
    passages = dc.passages_of(bench)
    idf, basis = dc.fit(dc.text_rows(docs(rows)).repartition(3), passages)
    bag = lambda h: np.bincount((h % np.uint64(dc.BUCKETS)).astype(np.int64), minlength=dc.BUCKETS)
    texts = np.stack([bag(word_hashes(dc.plain(t or ""))) for _, t in rows])
    assert np.allclose(idf, np.log((len(rows) + 1) / ((texts > 0).sum(0) + 0.5)).clip(0.01), rtol=1e-5)
    unit = lambda x: (x := x * idf) / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    every = np.concatenate([unit(texts) * np.sqrt(len(passages) / len(rows)), unit(np.stack([bag(p.words) for p in passages]))])
    want = np.square(np.linalg.svd(every @ every.T, hermitian=True)[1][: dc.RANK] ** 0.5).sum()
    assert np.square(every @ (basis / idf[:, None])).sum() > 0.97 * want


def test_products_of_many_short_and_few_long_rows(spark):
    rng = np.random.default_rng(6)
    rows = [sorted(rng.choice(300, k, replace=False).tolist()) for k in [2, 3, 1, 5] * 90 + [250]]
    values = [rng.standard_normal(len(r)).tolist() for r in rows]
    plain = np.zeros((len(rows), 300))
    for k, (r, v) in enumerate(zip(rows, values, strict=True)):
        plain[k, r] = v
    v, s = dc.randomised_svd(spark.createDataFrame(list(zip(rows, values, strict=True)), "at array<int>, value array<float>").repartition(2), rank=290)
    assert np.allclose(s[:200], np.linalg.svd(plain)[1][:200], rtol=1e-3)
    assert not v[300:].any() or abs(v[300:, :200]).max() < 1e-4
