import random

import numpy as np
import pytest
from brute import cut_repeats
from pyspark.sql import functions as F
from stratalog.llm import suffix_dedup as sd


def got(df):
    out = df.select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("k"), "kept_sha256").collect()
    return sorted(map(tuple, out), key=str)


def texts(seed, docs=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(4, 60))) for _ in range(8)]
    rows = []
    for d in rng.sample(range(1000), docs):
        t = ""
        for _ in range(rng.randrange(0, 7)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            t += rng.choice([word(), p, p[a:], p[:a], p[a : a + 49], "a" * rng.randrange(120)])
        rows.append((d, t))
    return rows


CASES = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 49), (5, "y" * 50), (6, "y" * 50), (None, "y" * 50), (7, "z" * 300), (8, "z" * 120 + "q"), (9, "ab" * 60), (11, "ba" * 60), (9, "ab" * 60), (5, "z" * 80)]


def test_cases(docs):
    assert got(sd.suffix_dedup(docs(CASES))) == cut_repeats(CASES)
    assert sd.suffix_dedup(docs([])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(docs, seed):
    rows = texts(seed)
    assert got(sd.suffix_dedup(docs(rows))) == cut_repeats(rows)


def test_hot_files_are_split(docs, monkeypatch):
    monkeypatch.setattr(sd, "HOT_FILE", 2)
    monkeypatch.setattr(sd, "ARRAY_BYTES", 500)
    rows = texts(7)
    assert got(sd.suffix_dedup(docs(rows))) == cut_repeats(rows)


def test_table(table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    assert got(sd.suffix_dedup(table("documents"))) == cut_repeats(rows)


def test_suffix_array():
    rng = np.random.default_rng(4)
    for n, k in ((1, 1), (7, 1), (300, 2), (500, 5), (2000, 60)):
        text = rng.integers(1, k + 1, n).astype(np.uint8)
        array, raw = sd.suffix_array(text, 56), text.tobytes()
        assert sorted(array.tolist()) == list(range(n))
        cut = [raw[i : i + 56] for i in array]
        assert cut == sorted(cut)
        same = sd.common_prefixes(text, array[:-1], array[1:])
        for a, b, x in zip(array[:-1], array[1:], same, strict=True):
            assert raw[a : a + x] == raw[b : b + x] and (x == 50 or raw[a + x : a + x + 1] != raw[b + x : b + x + 1])


def test_batches_of_a_file_are_carried():
    import pyarrow as pa

    rows = [(1, 5, d, 0, d, 3) for d in range(3)] + [(2, 5, 1, 0, 0, 3), (2, 6, 4, 0, 0, 3), (2, 6, 9, 0, 0, 3), (3, 1, 1, 0, 0, 1)]
    names = ("h", "s", "doc_id", "t", "lo", "n")
    one = lambda rs: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rs], pa.int64()) for k in range(6)], names)
    flat = lambda bs: sorted(tuple(r.values()) for b in sd._match(iter(bs)) for r in b.to_pylist())
    assert flat([one(rows)]) == flat([one([r]) for r in rows]) == flat([one(rows[:4]), one([]), one(rows[4:])])


def test_repeats_against_plain():
    rng = random.Random(5)
    rows = [t.encode() for _, t in texts(11, 60) if t] + [b"", b"a" * 49, b"a" * 200]
    owner = np.array([rng.randrange(20) for _ in rows])
    lowest = {}
    for d, x in zip(owner.tolist(), rows, strict=True):
        for i in range(len(x) - 49):
            lowest[x[i : i + 50]] = min(lowest.get(x[i : i + 50], d), d)
    want = {(k, i) for k, x in enumerate(rows) for i in range(len(x) - 49) if lowest[x[i : i + 50]] < owner[k]}
    runs = list(zip(*sd.repeats(np.frombuffer(b"".join(rows), np.uint8), np.array([len(x) for x in rows]), owner), strict=True))
    assert {(k, f + i) for k, f, n in runs for i in range(n)} == want and want
    assert all((k, f - 1) not in want and (k, f + n) not in want for k, f, n in runs)


def test_shared_files_are_those_of_two_documents(spark, docs, monkeypatch):
    """Also where a file's documents are read in several goes and its bits meet in several
    tasks. A clear bit for every other file is what keeps the work in proportion."""
    monkeypatch.setattr(sd, "NOTED", 300)
    monkeypatch.setattr(sd, "TASK_BYTES", 4000)
    rows = texts(3, 60)
    of = {}
    for d, t in rows:
        for h in sd.segments(t.encode())[0].tolist():
            of.setdefault(h, set()).add(d)
    place = lambda h: int(sd.mixed(np.array([h], np.uint64))[0]) >> 64 - sd.FILE_BITS
    known = docs(rows).selectExpr("doc_id", "xxhash64(text) t", "cast(text as binary) text").repartition(3)
    reps = spark.sparkContext.broadcast(sd.key_bitmap(known, "doc_id"))
    words = sd.shared_files(known, reps, sum(len(t.encode()) for _, t in rows))
    got = {int(w) * 64 + k for w in np.flatnonzero(words) for k in range(64) if int(words[w]) >> k & 1}
    assert got == {place(h) for h, ds in of.items() if len(ds) > 1} and len(got) < len(of)
    # Room for the shared files of 6 GB (33 million at the rate of the 0.5 GB table): the
    # bitmap must rule out nine in ten of the others.
    assert 33e6 / (64 * len(words)) < 0.1


def test_cut_segments(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sd, "CUT_BYTES", 100)
    data = [bytes(range(32, 126)) * 2, b"x" * 60, b"y" * 70]
    asked = [[(7, 3, 10, False), (8, 5, 2, True)], [], [(9, 0, 21, False)]]
    kind = pa.list_(pa.struct([("h", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("hot", pa.bool_())]))
    one = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([11, 12, 13]), pa.array(data, pa.binary()), pa.array([[dict(zip(("h", "lo", "n", "hot"), a, strict=True)) for a in x] for x in asked], kind)], ["doc_id", "t", "text", "asked"])
    got = [tuple(r.values()) for b in sd._cut_segments(iter([one, one.slice(2), one.slice(1, 1)])) for r in b.to_pylist()]
    assert [g[1:] for g in got] == [(1, 11, 3, data[0][3:62]), (1, 11, 5, data[0][5:55]), (1, 11, 6, data[0][6:56])] + [(3, 13, 0, data[2])] * 2
    assert [got[k][0] for k in (0, 3, 4)] == [7, 9, 9] and got[1][0] != got[2][0]
