import math
import random
import zlib

import numpy as np
import pytest
from brute import KneserNey
from stratalog.llm import toxicity as tx


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    syllables = ["an", "er", "the", "on", "in", "re", "ti", "st", "ha", "nd"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for d in range(n):
        toxic = d % 7 == 0
        words = [word() for _ in range(rng.randrange(5, 150))]
        if toxic:
            words += [rng.choice(["zorgle", "Zorgles", "quxfip"]) for _ in range(3)]
        rng.shuffle(words)
        docs.append((d, " ".join(words)))
        labels.append((d, 1, int(toxic)))
    return docs, labels


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out(docs, labels):
    rows, marks = corpus()
    out = {r.doc_id: r for r in tx.toxicity(docs(rows), labels(marks)).collect()}
    held = [(out[d].score, y) for d, _, y in marks if out[d].held_out]
    assert {d for d, r in out.items() if r.held_out} == {d for d, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.97
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in out.values())
    kept = tx.accepted(docs(rows), labels(marks))
    assert kept.columns == docs([]).columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in out.items() if r.score < 0.5}


def test_cases(docs, labels):
    rows = [(1, None), (2, ""), (3, "..."), (None, "x"), (3, "..."), (4, "word " * 100_000), (None, None)]
    for marks in ([], [(1, 1, 0), (3, None, None), (None, 0, 1)], corpus(60)[1]):
        out = tx.toxicity(docs(rows), labels(marks)).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.held_out is not None for r in out)
    assert tx.toxicity(docs([]), labels([(1, 1, 1)])).count() == 0


def test_grams():
    grams, word = tx.word_grams([b"ab", b"c"])
    assert [int(g).to_bytes(6, "big") for g in grams] == [b"     a", b"    ab", b"   ab ", b"     c", b"    c "]
    assert word.tolist() == [0, 0, 0, 1, 1]


def test_curve():
    x, y = np.array([0, 0.1, 0.2, 1, 1.1, 1.2]), np.array([0, 0, 0, 1, 1, 1.0])
    a, b = tx.fit_curve(x, y)
    assert a > 0 and a * 0.2 + b < 0 < a * 1 + b
    assert tx.fit_curve(np.zeros(0), np.zeros(0)) == (1.0, 0.0)


def plain_words(text):
    return "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in (text or "").lower()).encode().split()


def learnt(rows, marks, folds):
    """A plain model of the labelled rows of some folds."""
    toxic = {}
    for d, _, y in marks:
        toxic[d] = max(toxic.get(d, 0), y)
    return KneserNey([(w, toxic[d]) for d, t in rows if d in toxic and zlib.crc32(str(d).encode()) % 5 in folds for w in plain_words(t)])


def agrees(rows, marks, frame, labels):
    """Every document's score is the plain models' one."""
    out = {r.doc_id: r.score for r in tx.toxicity(frame, labels).collect()}
    model, (slope, bias) = learnt(rows, marks, (1, 2, 3, 4)), tx.train(frame, labels)[1]
    known = {}

    def raw(model, t):
        words = plain_words(t)
        for w in words:
            if w not in known:
                known[w] = model.evidence(w, tx.MARGIN)
        return sum(known[w] for w in words) / max(1, len(words)) ** 0.5

    for d, t in rows:
        assert out[d] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, slope * raw(model, t) + bias)))), abs=1e-6)
    known.clear()
    model, toxic = learnt(rows, marks, (1, 2, 3)), {d: y for d, _, y in marks}
    four = [(raw(model, t), toxic[d]) for d, t in rows if d in toxic and zlib.crc32(str(d).encode()) % 5 == 4]
    assert (slope, bias) == pytest.approx(tx.fit_curve(np.array([x for x, _ in four]), np.array([float(y) for _, y in four])), rel=1e-4)
    return out


def test_against_plain_kneser_ney(docs, labels, monkeypatch):
    monkeypatch.setattr(tx, "BLOCK_GRAMS", 700)  # several blocks and groups
    monkeypatch.setattr(tx, "GROUP_ROWS", 100)
    rows, marks = corpus(300, seed=9)
    out = agrees(rows, marks, docs(rows), labels(marks))
    assert len({round(s, 6) for s in out.values()}) > 10


def test_table_against_plain_kneser_ney(table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    marks = [(r.doc_id, r.quality, r.toxic) for r in table("labels").collect()]
    agrees(rows, marks, table("documents"), table("labels"))


def test_plain_probabilities_sum_to_one():
    """So those of the operator, which agree, do too."""
    model = KneserNey([(w, k % 2) for k, w in enumerate([b"abab", b"abba", b"baab", b"bbbb"] * 3)])
    for order, context in ((5, b"  ab"), (3, b"ab"), (2, b"a"), (1, b""), (4, b"zzz")):
        assert sum(model.p(context + bytes([x]), order) for x in range(256)) == pytest.approx(1)


def test_curve_fold_is_learnt_from(spark, docs, labels):
    """An expression that only fold 4 holds is known."""
    rows, marks = corpus()
    four = [d for d, _, y in marks if y and zlib.crc32(str(d).encode()) % tx.FOLDS == tx.CURVE_FOLD]
    rows = [(d, t + " vexbrumf vexbrumf" if d in four else t) for d, t in rows]
    asked = spark.createDataFrame([(bytearray(b"vexbrumf"),), (bytearray(b"thean"),)], "word binary")
    got = tx.evidence(asked, tx.train(docs(rows), labels(marks))[0]).collect()
    assert [bytes(r.word) for r in got] == [b"vexbrumf"]


def test_rows_that_share_an_id_are_judged_by_their_own_text(docs, labels):
    rows, marks = corpus()
    rows += [(None, "zorgle quxfip zorgle"), (None, "thean"), (10_000, "zorgle quxfip zorgle"), (10_000, "thean"), (10_000, "thean")]
    kept = sorted((r.doc_id or 0, r.text) for r in tx.accepted(docs(rows), labels(marks)).collect() if r.doc_id is None or r.doc_id == 10_000)
    assert kept == [(0, "thean"), (10_000, "thean"), (10_000, "thean")]


def test_curve_is_fitted_on_the_whole_fold(docs, labels, monkeypatch):
    """No bound on its rows counts."""
    monkeypatch.setattr(tx, "CURVE_ROWS", 5, raising=False)
    rows, marks = corpus(300, seed=4)
    agrees(rows, marks, docs(rows), labels(marks))


def test_curve_of_a_table_is_that_of_its_rows(spark):
    rng = random.Random(8)
    rows = [(round(rng.gauss(y, 0.8), 1), y) for y in (0, 1, 0, 0) for _ in range(300)]
    frame = lambda r: spark.createDataFrame(r, "raw double, toxic int").repartition(3)
    want = tx.fit_curve(np.array([x for x, _ in rows]), np.array([float(y) for _, y in rows]))
    assert tx.fitted_curve(frame(rows)) == pytest.approx(want, rel=1e-6)
    assert tx.fitted_curve(frame([])) == (1.0, 0.0)
    for y in (0, 1):
        only = [(float(k), y) for k in range(9)]
        assert tx.fitted_curve(frame(only)) == tx.fit_curve(np.array([x for x, _ in only]), np.array([float(y)] * 9))
