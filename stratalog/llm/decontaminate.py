"""Benchmark decontamination by latent semantic retrieval.

Passages and texts become TF-IDF vectors over hashed words. A distributed randomised SVD of
the benchmark's passages and all texts of the corpus gives a latent space. The
share of a window's squared weights that lies in words of the benchmark tells how like a
passage it can be; running sums give that share for every window of every document, and
those with enough (an approximation, whose recall is measured) are folded into the space
and compared with the passages of about their length by cosine. Candidates are confirmed by the longest
common subsequence of words and by a check that the answer (the end of the passage) is
there too, which lets paraphrases through but not chance likeness.

The benchmark is a stated query set against all rows: it is held in blocks of a fixed
size, each of which is one pass over the documents. Document frequencies, the space,
windows, candidates and checks cover every row and text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, lean, shared, text_pieces, text_rows, word_hashes, written

#: Word buckets (a prime), latent dimensions, surplus and power rounds of the SVD.
BUCKETS, RANK, SURPLUS, ROUNDS = 16_381, 48, 16, 2
#: Words of a passage at most, passages of a block of the benchmark, and words that are
#: folded in at once.
PASSAGE_WORDS, BLOCK_PASSAGES, FOLD_WORDS = 64, 4_096, 16_384
#: Buckets that travel together in a product, pieces of text whose counts are held in a row.
CHUNK, HELD_PIECES = 256, 8
#: Least share of squared weights in words of the benchmark, least cosine of a candidate
#: as a share of the passage's own with its image, and least shares of the passage and of
#: its answer in what is reported.
LEAST_MASS, LEAST_COSINE, LEAST_SHARE, LEAST_ANSWER = 0.35, 0.6, 0.75, 0.5
#: Bits of the table of the benchmark's words.
WORD_BITS = 20
#: Passages of fewer words must be found as they are.
SHORT = 8

_STRIP = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))
_PLAIN = bytes(32 if b in _STRIP else b for b in range(256))


def plain(text: str) -> bytes:
    """Lower-cased, with ASCII punctuation blanked."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bits of a at once."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@dataclass
class Passage:
    item_id: int
    words: np.ndarray  # hashes

    @property
    def answer(self) -> np.ndarray:
        """The end of the passage: its last quarter, four words at least."""
        return self.words[-max(4, len(self.words) // 4) :]


def passages_of(items: Iterable[tuple[int, str | None]]) -> list[Passage]:
    """Items cut into equal passages of PASSAGE_WORDS at most; items without words have none."""
    out = []
    for item, text in items:
        h = word_hashes(plain(text or ""))
        if len(h):
            out += [Passage(item, p) for p in np.array_split(h, -(-len(h) // PASSAGE_WORDS))]
    return out


_BAGS = "texts long, held long, at binary, n binary, size binary"
Vectors = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _bags(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts given as word hashes, one text after another: the distinct buckets of each,
    how often they stand there, and how many each text has."""
    texts = len(first) - 1
    key = (h % np.uint64(BUCKETS)).astype(np.int64) + np.repeat(np.arange(texts) * BUCKETS, np.diff(first))
    if texts * BUCKETS < 1 << 31:
        key = key.astype(np.int32)
    key.sort()
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    n, key = np.diff(np.append(new, len(key))), key[new]
    of = key // BUCKETS
    return (key - of * BUCKETS).astype(np.uint16), n.astype(np.uint32), np.bincount(of, minlength=texts).astype(np.uint32)


def _packed(bags: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict:
    """A row of _BAGS."""
    at, n, size = (np.concatenate(x) for x in zip(*bags, strict=True))
    parts = {k: pa.compress(x.tobytes(), codec="zstd", asbytes=True) for k, x in (("at", at), ("n", n), ("size", size))}
    return {"texts": len(size), "held": len(at)} | parts


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = (("at", np.uint16, "held"), ("n", np.uint32, "held"), ("size", np.uint32, "texts"))
    return tuple(np.frombuffer(pa.decompress(row[k], row[many] * np.dtype(t).itemsize, codec="zstd"), t) for k, t, many in kinds)


@lean
def _count(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _BAGS of (text)."""
    names = ("texts", "held", "at", "n", "size")
    kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 3)
    for b in it:
        held = []
        for p in text_pieces(b.column(0), plain):
            held.append(_bags(p.hashes, p.first))
            if len(held) == HELD_PIECES or p.number + len(p.first) - 1 == b.num_rows:
                row, held = _packed(held), []
                yield batches({c: ([row[c]], t) for c, t in zip(names, kinds, strict=True)})


def document_frequency(bags: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold a word of each bucket, over all documents; BUCKETS + 1 rows
    come to the driver."""

    @lean
    def count(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for b in it:
            for row in b.to_pylist():
                total[:-1] += np.bincount(_unpacked(row)[0], minlength=BUCKETS)
                total[-1] += row["texts"]
        yield batches({"at": (np.arange(BUCKETS + 1), pa.int64()), "n": (total, pa.int64())})

    got = bags.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[got["at"].to_numpy()] = got["n"].to_numpy()
    return df[:-1], int(df[-1])


def _vectors(b: pa.RecordBatch) -> Vectors:
    """Those of (at array<int>, value array<float>) rows."""
    at, value = (b.column(k).flatten().to_numpy() for k in (0, 1))
    yield at, value, np.diff(b.column(0).offsets.to_numpy())


def randomised_svd(vectors: DataFrame, rank: int = RANK, seed: int = 7, read: Callable[[pa.RecordBatch], Vectors] = _vectors) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors, singular values) of sparse rows, which `read` takes from
    the batches of a table as (buckets, values, how many each row has): subspace iteration
    on A'A, one distributed product per round. Each task sends one BUCKETS x (rank +
    SURPLUS) matrix, by chunks, whose sums over all tasks come to the driver."""
    context = vectors.sparkSession.sparkContext

    def product(q: np.ndarray, gram: bool = False) -> np.ndarray:
        sent = context.broadcast(q.astype(np.float32))
        shape = (q.shape[1], q.shape[1]) if gram else q.shape

        @lean
        def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, out, some = sent.value, np.zeros(shape), False
            place = np.zeros(len(q), np.int64)
            for b in it:
                for at, value, size in read(b):
                    size, some = size[size > 0].astype(np.int64), True
                    edge = np.concatenate(([0], np.cumsum(size)))
                    # Some rows at once, dense in the buckets that they hold.
                    step = int(np.clip(len(at) // max(1, len(size)), 64, 512))
                    for low in range(0, len(size), step):
                        n = size[low : low + step]
                        here = slice(edge[low], edge[low + len(n)])
                        hold = np.zeros(len(q), bool)
                        hold[at[here]] = True
                        used = np.flatnonzero(hold)
                        place[used] = np.arange(len(used))
                        dense = np.zeros((len(n), len(used)), np.float32)
                        dense[np.repeat(np.arange(len(n)), n), place[at[here]]] = value[here]
                        y = dense @ q[used]
                        if gram:
                            out += y.T @ y
                        else:
                            out[used] += dense.T @ y
            if some:
                at = range(0, len(out), CHUNK)
                yield batches({"k": (list(at), pa.int64()), "part": ([out[k : k + CHUNK].astype(np.float32).tobytes() for k in at], pa.binary())})

        def add(group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(p.as_buffer(), np.float32).astype(np.float64) for p in group["part"])
            return pa.table({"k": [group["k"][0].as_py()], "part": pa.array([total.tobytes()], pa.binary())})

        got = vectors.mapInArrow(run, "k long, part binary").groupBy("k").applyInArrow(add, "k long, part binary").toArrow()
        sent.destroy()
        total = np.zeros(shape)
        for k, part in zip(got["k"].to_pylist(), got["part"], strict=True):
            total[k : k + CHUNK] = np.frombuffer(part.as_buffer()).reshape(-1, shape[1])
        return total

    q = np.random.default_rng(seed).standard_normal((BUCKETS, rank + SURPLUS))
    q = np.linalg.qr(q)[0]
    for _ in range(ROUNDS + 1):
        q = np.linalg.qr(product(q))[0]
    value, vector = np.linalg.eigh(product(q, gram=True))
    top = np.argsort(value)[::-1][:rank]
    return q @ vector[:, top], np.sqrt(np.maximum(value[top], 0))


@dataclass
class Block:
    """Passages, with those of like length side by side, and what folds text in."""

    passages: list[Passage]
    idf: np.ndarray  # by bucket
    basis: np.ndarray  # buckets x rank: idf times the right singular vectors

    def __post_init__(self) -> None:
        at = [(p.words % np.uint64(BUCKETS)).astype(np.int64) for p in self.passages]
        latent = np.stack([self.basis[i].sum(0) for i in at]).astype(np.float64)
        image = np.maximum(np.linalg.norm(latent, axis=1), 1e-9)
        whole = np.sqrt([np.square(np.bincount(i) * self.idf[: i.max() + 1]).sum() for i in at])
        self.latent = (latent / image[:, None]).astype(np.float32)
        self.least = (LEAST_COSINE * image / np.maximum(whole, 1e-9)).astype(np.float32)
        self.weight = np.square(self.idf).astype(np.float64)
        self.known = np.zeros(1 << WORD_BITS, bool)
        self.known[np.concatenate([p.words for p in self.passages]) >> np.uint64(64 - WORD_BITS)] = True
        self.sets = [set(p.words.tolist()) for p in self.passages]
        size = self.size = np.array([len(p.words) for p in self.passages])
        self.length, self.reach = size.tolist(), (size // 4 + 2).tolist()
        self.needed = [len(s) - (m + int(-LEAST_SHARE * m // 1)) for s, m in zip(self.sets, self.length, strict=True)]
        self.by_size = [(w, m) for low, w in self.bands() if len(m := np.flatnonzero((size > low) & (size <= w)))]

    @staticmethod
    def bands() -> list[tuple[int, int]]:
        edges = [0, 8, 12, 16, 20, 26, 32, 40, 50, PASSAGE_WORDS]
        return list(zip(edges[:-1], edges[1:], strict=True))

    def candidates(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(passage, first word, words, cosine) of windows of texts given as word hashes,
        one text after another. A window's norm is that of its full vector (words counted
        singly), not of its image, so what the space can't express counts against it; its
        image is a difference of running sums."""
        at = (h % np.uint64(BUCKETS)).astype(np.int64)
        weight = self.weight[at]
        ours = np.where(self.known[h >> np.uint64(64 - WORD_BITS)], weight, 0)
        mass, held = (np.concatenate(([0.0], np.cumsum(x))) for x in (weight, ours))
        first, size = first[:-1][np.diff(first) > 0], np.diff(first)[np.diff(first) > 0]
        windows = []
        for wide, members in self.by_size:
            step, n = max(1, wide // 8), np.minimum(wide, size)
            count = -((n - size) // step) + 1
            text = np.repeat(np.arange(len(first)), count)
            nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            start = first[text] + np.minimum(nth * step, (size - n)[text])
            end = start + n[text]
            total = mass[end] - mass[start]
            may = held[end] - held[start] >= LEAST_MASS * total
            windows.append((members, start[may], end[may], total[may]))
        found, covered = [], np.zeros(len(at) + 1, np.int64)
        for _, start, end, _ in windows:
            covered += np.bincount(start, minlength=len(covered)) - np.bincount(end, minlength=len(covered))
        covered = np.cumsum(covered[:-1])
        for low in range(0, len(at), FOLD_WORDS):
            folded = None
            for members, start, end, total in windows:
                here = slice(*np.searchsorted(start, (low, low + FOLD_WORDS)))
                s, e = start[here], end[here]
                if not len(s):
                    continue
                if folded is None:
                    part = np.arange(low, min(low + FOLD_WORDS + PASSAGE_WORDS, len(at)))
                    part = part[covered[part] > 0]  # every word of these windows
                    folded = np.zeros((len(part) + 1, self.basis.shape[1]))
                    folded[1:] = self.basis[at[part]]
                    np.cumsum(folded, axis=0, out=folded)
                    place = np.searchsorted(part, np.arange(low, low + FOLD_WORDS + PASSAGE_WORDS + 1))
                window = (folded[place[e - low]] - folded[place[s - low]]) / np.sqrt(np.maximum(total[here], 1e-9))[:, None]
                cosine = window.astype(np.float32) @ self.latent[members].T
                w, p = np.nonzero(cosine >= self.least[members])
                found.append((members[p], s[w], (e - s)[w], cosine[w, p]))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(0, np.float32)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def findings(self, texts: list[str] | pa.Array) -> Iterator[tuple[int, int | None, float, float, float]]:
        """(number of the text, item_id, cosine, share, answer share) of the passages found
        in texts, the best of each item."""
        for piece in text_pieces(texts, plain):
            h, first = piece.hashes, piece.first
            p, start, n, cosine = self.candidates(h, first)
            text = np.searchsorted(first, start, side="right") - 1
            region = (start - first[text]) // (self.size[p] // 4 + 2)
            order = np.lexsort((n, start, cosine, region, p, text))
            last = np.ones(len(order), bool)  # the best place of each region is tried
            last[:-1] = (np.diff(text[order]) != 0) | (np.diff(p[order]) != 0) | (np.diff(region[order]) != 0)
            order = order[last]
            order = order[np.lexsort((-n[order], -start[order], -cosine[order], p[order], text[order]))]
            best: dict[tuple[int, int | None], tuple[float, float, float]] = {}
            words, done = h.tolist() if len(order) else [], None
            for t, k, s, wide, c in zip(*(x[order].tolist() for x in (text, p, start, n, cosine)), strict=True):
                if (t, k) == done:
                    continue
                got = self._confirmed(k, h, words, max(int(first[t]), s - self.reach[k]), min(int(first[t + 1]), s + max(wide, self.length[k]) + self.reach[k]))
                if got:
                    done = (t, k)
                    name = (t, self.passages[k].item_id)
                    best[name] = max(best.get(name, (0.0, 0.0, 0.0)), (c, *got))
            yield from ((piece.number + t, item, *best[t, item]) for t, item in sorted(best, key=lambda x: (x[0], x[1] is None, x[1] or 0)))

    def _confirmed(self, k: int, h: np.ndarray, words: list[int], low: int, high: int) -> tuple[float, float] | None:
        """Shares of a passage and of its answer in a region, if they suffice."""
        m, wanted = self.length[k], self.sets[k]
        # Words that the region lacks are missing from any common subsequence.
        if len(wanted.intersection(words[low:high])) < self.needed[k]:
            return None
        passage, region = self.passages[k], h[low:high]
        if m < SHORT:
            share = answer = float(any((region[i : i + m] == passage.words).all() for i in range(len(region) - m + 1)))
        else:
            share = lcs(passage.words, region) / m
            answer = lcs(passage.answer, region) / len(passage.answer)
        return (share, answer) if share >= LEAST_SHARE and answer >= LEAST_ANSWER else None


def fit(rows: DataFrame, passages: list[Passage]) -> tuple[np.ndarray, np.ndarray]:
    """(idf, basis): frequencies over all rows, the space on the unit vectors of all
    passages and of all texts, those of the texts weighing together as much as those of
    the passages."""
    spark = rows.sparkSession
    bags = written(rows.select("text").mapInArrow(_count, _BAGS), "word-counts")
    df, n = document_frequency(bags)
    idf = np.log((n + 1) / (df + 0.5)).clip(0.01)
    sent = spark.sparkContext.broadcast(idf)

    def weighed(b: pa.RecordBatch) -> Vectors:
        for row in b.to_pylist():
            at, n, size = _unpacked(row)
            size = size.astype(np.int64)
            value = n * sent.value[at]
            some = size[size > 0]
            if len(some):
                norm = np.sqrt(np.add.reduceat(value * value, np.cumsum(some) - some))
                yield at, (value * np.repeat(row["weight"] / norm, some)).astype(np.float32), size

    own = []
    for k in range(0, len(passages), 512):
        words = [p.words for p in passages[k : k + 512]]
        own.append(_packed([_bags(np.concatenate(words), np.concatenate(([0], np.cumsum([len(w) for w in words]))))]) | {"weight": 1.0})
    own = spark.createDataFrame(own, f"{_BAGS}, weight double")
    texts = bags.withColumn("weight", F.lit(float(np.sqrt(len(passages) / max(1, n)))))
    v, _ = randomised_svd(texts.unionByName(own), read=weighed)
    return idf.astype(np.float32), (v * idf[:, None]).astype(np.float32)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, share, answer_share): the items found in each document.

    Documents without findings have no row. Null texts and items count as empty and match
    nothing; rows with a null doc_id are searched like others; repeated rows repeat their
    findings, repeated items are one. Empty tables give an empty result; other columns
    are not read.
    """
    rows, spark = text_rows(docs), docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    passages = passages_of((r["item_id"], r["text"]) for r in items.orderBy("item_id", "text").toLocalIterator())
    schema = "doc_id long, item_id long, cosine double, share double, answer_share double"
    if not passages:
        return spark.createDataFrame([], schema)
    idf, basis = fit(rows, passages)
    out = None
    for k in range(0, len(passages), BLOCK_PASSAGES):
        block = shared(spark, Block(passages[k : k + BLOCK_PASSAGES], idf, basis))

        @lean
        def find(it: Iterable[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for b in it:
                ids = b.column(0).to_pylist()
                got = [(ids[f[0]], *f[1:]) for f in block().findings(b.column(1))]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                names = ("doc_id", "item_id", "cosine", "share", "answer_share")
                yield batches({c: ([g[j] for g in got], t) for j, (c, t) in enumerate(zip(names, kinds, strict=True))})

        found = rows.mapInArrow(find, schema)
        out = found if out is None else out.unionByName(found)
    if len(passages) <= BLOCK_PASSAGES:
        return out
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("cosine", "share", "answer_share")])
