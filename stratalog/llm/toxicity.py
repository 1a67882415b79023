"""Toxicity by class-conditional Kneser-Ney models.

Each class has an interpolated Kneser-Ney model of the letters of words (six bytes, the
word's start and end marked). Below the highest order both classes back off to the same
continuation counts, of five bytes down to one, so a rare expression that neither class
knows better scores the same in both. A word's evidence is its toxic less its ordinary
log-likelihood, divided by its length, above a margin; a document's is the sum over its
words divided by the root of their number. A logistic curve fitted on all labelled rows of
a held-back fold turns it into a probability.

All labelled rows of the training folds are counted, exactly, by their grams, so the model
grows with the input. It is held in blocks of a bounded size, which only the distinct words
of the corpus meet; documents then send just those words that a bitmap of a fixed size
can't rule out of the words with evidence, and these are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, empty_text, in_bitmap, key_bitmap, lean, only_in_bitmap, text_pieces, text_rows, written

DISCOUNT = 0.75
MARGIN = 0.8
FOLDS, TEST_FOLD, CURVE_FOLD = 5, 0, 4
#: Words of which a task remembers that it has sent them.
SENT = 300_000
#: Words whose grams are made at once, and grams that a task works on at once, at least.
GRAM_WORDS, GROUP_ROWS = 20_000, 100_000
#: Grams and contexts of a block of the model, about (32 MB), and the prime that deals them out.
BLOCK_GRAMS, SPREAD = 1 << 21, 999_983

_LETTERS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def letters(text: str) -> bytes:
    """Lower-cased, with ASCII characters other than letters and digits blanked."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS)


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The six-byte grams, packed into 48 bits, of each word between its marks, and the
    word's number for each."""
    raw = np.frombuffer(b"".join(b"     " + w + b" " for w in words), np.uint8).astype(np.int64)
    size = np.array([len(w) + 1 for w in words], np.int64)
    end = np.repeat(np.cumsum(size + 5) - size, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    gram = np.zeros(len(end), np.int64)
    for k in range(5, -1, -1):
        gram = (gram << 8) | raw[end - k]
    return gram, np.repeat(np.arange(len(words)), size)


def _slopes(x: np.ndarray, y: np.ndarray, times: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The gradient (2) and the curvature (2 x 2, flat) of rows' log-likelihood at w."""
    a = np.column_stack([x, np.ones(len(x))])
    p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
    return np.concatenate([a.T @ (times * (y - p)), (a.T @ (a * (times * p * (1 - p))[:, None])).ravel()])


def _newton(rows: int, ones: int, slopes: Callable[[np.ndarray], np.ndarray]) -> tuple[float, float]:
    """Logistic curve by Newton's method with a slight ridge; the prior share without x."""
    if ones in (0, rows):
        share = (ones + 0.5) / (rows + 1)
        return 1.0, float(np.log(share / (1 - share)))
    w, keep = np.zeros(2), np.diag([1e-3, 1e-3])
    for _ in range(50):
        got = slopes(w)
        step = np.linalg.solve(got[2:].reshape(2, 2) + keep, got[:2] - keep @ w)
        w += np.clip(step, -20, 20)
        if abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The curve of scores x and labels y (0 or 1)."""
    return _newton(len(y), int(y.sum()), lambda w: _slopes(x, y, np.ones(len(y)), w))


def fitted_curve(scored: DataFrame) -> tuple[float, float]:
    """fit_curve() of all (raw, toxic) rows, wherever they are: each step of Newton's method
    is a pass over the distinct ones, of which every task sends six sums."""
    pairs = scored.groupBy("raw", (F.col("toxic") > 0).cast("double").alias("y")).agg(F.count("*").cast("double").alias("times"))
    pairs = written(pairs, "curve-rows")
    rows, ones = pairs.agg(F.sum("times"), F.sum(F.col("times") * F.col("y"))).first()

    def slopes(w: np.ndarray) -> np.ndarray:
        @lean
        def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = np.zeros(6)
            for b in it:
                got += _slopes(*(c.to_numpy() for c in b.columns), w)
            yield batches({"got": ([got.tolist()], pa.list_(pa.float64()))})

        got = pairs.mapInArrow(run, "got array<double>").toArrow()["got"].to_pylist()
        return np.sum(got, axis=0) if got else np.zeros(6)

    return _newton(int(rows or 0), int(ones or 0), slopes)


# Words


@lean
def _count_words(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c0 .. c3) of (text, kind): how often the rows of each of four kinds hold a word."""
    for b in rows:
        kind, words, keys, counts = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64), {}, [], []
        for p in text_pieces(b.column(0), letters):
            key, at, back = np.unique(p.hashes, return_index=True, return_inverse=True)
            of = np.repeat(kind[p.number : p.number + len(p.first) - 1], np.diff(p.first))
            keys.append(key)
            counts.append(np.bincount(back * 4 + of, minlength=4 * len(key)).reshape(-1, 4))
            for k, s, e in zip(key.tolist(), p.start[at].tolist(), p.end[at].tolist(), strict=True):
                if k not in words:
                    words[k] = p.data[s:e]
        if words:
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros((len(key), 4), np.int64)
            np.add.at(total, back, np.concatenate(counts))
            yield batches({"word": ([words[k] for k in key.tolist()], pa.binary())} | {f"c{c}": (total[:, c], pa.int64()) for c in range(4)})


@lean
def _distinct_words(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word) of (text): each word at least once."""
    sent: set[int] = set()
    for b in rows:
        words = []
        for p in text_pieces(b.column(0), letters):
            key, at = np.unique(p.hashes, return_index=True)
            for k, s, e in zip(key.tolist(), p.start[at].tolist(), p.end[at].tolist(), strict=True):
                if k not in sent:
                    sent.add(k)
                    words.append(p.data[s:e])
        yield batches({"word": (words, pa.binary())})
        if len(sent) > SENT:
            sent.clear()


@lean
def _count_grams(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, c0, c1) of (word, c0, c1)."""
    for b in rows:
        for i in range(0, b.num_rows, GRAM_WORDS):
            part = b.slice(i, GRAM_WORDS)
            gram, word = word_grams(part.column(0).to_pylist())
            keys, at = np.unique(gram, return_inverse=True)
            c = [np.bincount(at, part.column(k).to_numpy()[word], len(keys)).astype(np.int64) for k in (1, 2)]
            yield batches({"gram": (keys, pa.int64()), "c0": (c[0], pa.int64()), "c1": (c[1], pa.int64())})


def distinct_words(rows: DataFrame) -> DataFrame:
    return rows.select("text").mapInArrow(_distinct_words, "word binary").distinct()


# The models


def _mix(c: np.ndarray, n: np.ndarray, f: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Kneser-Ney's mix of counts out of n, of f different ones, with the lower order."""
    return np.where(n > 0, (np.maximum(c - DISCOUNT, 0) + DISCOUNT * f * low) / np.maximum(n, 1), low)


def _suffixes(keys: np.ndarray, bytes_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct keys their distinct last bytes, how many keys end in each (its
    continuation count), and the sum and the number of these after the same context."""
    key, c = np.unique(keys & ((1 << 8 * bytes_) - 1), return_counts=True)
    _, at = np.unique(key >> 8, return_inverse=True)
    return key, c, np.bincount(at, c)[at], np.bincount(at)[at]


@dataclass
class LowOrders:
    """The shared probabilities of a byte after two others, by the three of them."""

    key: np.ndarray
    p: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, c: np.ndarray) -> LowOrders:
        """Of the distinct last three bytes of grams and their continuation counts."""
        one, c1, n1, f1 = _suffixes(np.unique(key & 0xFFFF), 1)
        low = np.full(256, 1 / 256)
        low[one] = _mix(c1, n1, f1, low[one])
        two, c2, n2, f2 = _suffixes(key, 2)
        low = _mix(c2, n2, f2, low[two & 0xFF])
        _, at = np.unique(key >> 8, return_inverse=True)
        return cls(key, _mix(c, np.bincount(at, c)[at], np.bincount(at)[at], low[np.searchsorted(two, key & 0xFFFF)]))


def gram_ratios(gram: np.ndarray, c0: np.ndarray, c1: np.ndarray, three: LowOrders) -> tuple[np.ndarray, np.ndarray]:
    """(key, ratio): the log of the toxic over the ordinary probability of each gram, and
    under -1 - context that of any other gram after its first five bytes. The grams are all
    those with the same third to fifth bytes, of one or more such groups: every count that
    is needed, but those of three bytes and fewer, is among them."""
    five, c5, n5, f5 = _suffixes(gram, 5)
    four, c4, n4, f4 = _suffixes(five, 4)
    low = _mix(c4, n4, f4, three.p[np.searchsorted(three.key, four & 0xFFFFFF)])
    low = _mix(c5, n5, f5, low[np.searchsorted(four, five & 0xFFFFFFFF)])[np.searchsorted(five, gram & 0xFFFFFFFFFF)]
    context, at = np.unique(gram >> 8, return_inverse=True)
    seen, other = [], []
    for c in (c0, c1):
        n, f = np.bincount(at, c), np.bincount(at, c > 0)
        seen.append(_mix(c, n[at], f[at], low))
        other.append(_mix(np.zeros(len(n)), n, f, np.ones(len(n))))
    return np.concatenate([gram, -1 - context]), np.concatenate([np.log(seen[1] / seen[0]), np.log(other[1] / other[0])])


def train_ratios(words: DataFrame) -> DataFrame:
    """(key, ratio) of gram_ratios() from (word, c0, c1) rows, one or more a word: one
    shuffle by the three bytes that all orders share. A group of them has 2**24 grams at
    most; what all groups need, the counts of three bytes, has 2**24 rows at most."""
    words = words.groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    grams = words.mapInArrow(_count_grams, "gram long, c0 long, c1 long").groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    grams = written(grams, "grams")
    four = grams.select(F.expr("gram & 4294967295L").alias("key")).distinct()
    got = four.groupBy(F.expr("key & 16777215L").alias("key")).agg(F.count("*").alias("c")).orderBy("key").toArrow()
    sent = grams.sparkSession.sparkContext.broadcast(LowOrders.of(got["key"].to_numpy(), got["c"].to_numpy()))

    @lean
    def ratios(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            key, ratio = gram_ratios(*cols, sent.value)
            return batches({"key": (key, pa.int64()), "ratio": (ratio, pa.float64())})

        for b in rows:
            held.append([c.to_numpy() for c in b.columns])
            size += b.num_rows
            if size >= GROUP_ROWS:
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                group = (cols[0] >> 8) & 0xFFFFFF
                last = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if last:
                    yield out([c[:last] for c in cols])
                held, size = [[c[last:] for c in cols]], len(group) - last
        if size:
            yield out([np.concatenate(c) for c in zip(*held, strict=True)])

    group = F.expr("shiftright(gram, 8) & 16777215L")
    return grams.withColumn("of", group).repartition("of").sortWithinPartitions("of").select("gram", "c0", "c1").mapInArrow(ratios, "key long, ratio double")


def word_sums(words: list[bytes], key: np.ndarray, ratio: np.ndarray, block: int, blocks: int) -> np.ndarray:
    """For each word the sum of the ratios of those of its grams whose context is filed in
    the block, whose sorted keys and ratios are given."""
    gram, word = word_grams(words)
    mine = (gram >> 8) % SPREAD % blocks == block
    distinct, back = np.unique(gram[mine], return_inverse=True)
    value = np.zeros(len(distinct))
    if len(key):
        for want in (-1 - (distinct >> 8), distinct):
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            value = np.where(key[at] == want, ratio[at], value)
    return np.bincount(word[mine], value[back], len(words))


def evidence(words: DataFrame, ratios: DataFrame) -> DataFrame:
    """(word, evidence) of those of the distinct words that have any.

    The ratios are held in blocks of a bounded size, by context, each one pass over the
    distinct words (never over documents); sums over blocks are added up by word."""
    spark, ratios = words.sparkSession, written(ratios, "gram-ratios")
    blocks = max(1, -(-ratios.count() // BLOCK_GRAMS))
    context = F.expr("if(key < 0, -1L - key, shiftright(key, 8))")
    every = None
    for block in range(blocks):
        got = ratios.where(context % SPREAD % blocks == block).select("key", F.col("ratio")).toArrow()
        order = np.argsort(got["key"].to_numpy())
        sent = spark.sparkContext.broadcast((got["key"].to_numpy()[order], got["ratio"].to_numpy()[order]))

        @lean
        def sums(rows: Iterable[pa.RecordBatch], sent=sent, block=block) -> Iterator[pa.RecordBatch]:
            for b in rows:
                for i in range(0, b.num_rows, GRAM_WORDS):
                    part = b.column(0).slice(i, GRAM_WORDS)
                    yield batches({"word": (part, pa.binary()), "sum": (word_sums(part.to_pylist(), *sent.value, block, blocks), pa.float64())})

        here = words.mapInArrow(sums, "word binary, sum double")
        every = here if every is None else every.unionByName(here.where("sum <> 0"))
    if blocks > 1:
        every = every.groupBy("word").agg(F.sum("sum").alias("sum"))
    above = F.round(F.col("sum") / F.greatest(F.octet_length("word") + 1, F.lit(3)) - MARGIN, 9)
    return every.select("word", above.alias("evidence")).where("evidence > 0")


# Documents


def raw_scores(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, t, raw) of (doc_id, t, text) rows, t being a key of the text."""
    lexicon = written(lexicon, "toxic-words")

    @lean
    def hashed(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield batches({"h": (np.concatenate([p.hashes for p in text_pieces(b.column(0), bytes)] or [np.zeros(0, np.uint64)]).view(np.int64), pa.int64())})

    sent = rows.sparkSession.sparkContext.broadcast(key_bitmap(lexicon.select("word").mapInArrow(hashed, "h long"), "h"))

    @lean
    def hits(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with its number of words, then a row for each word that may count."""
        for b in it:
            ids, keys = b.column(0), b.column(1)
            for p in text_pieces(b.column(2), letters):
                here = pa.array(np.arange(p.number, p.number + len(p.first) - 1))
                n = np.diff(p.first)
                may = np.flatnonzero(in_bitmap(sent.value, p.hashes.view(np.int64)))
                of = np.searchsorted(p.first, may, side="right") - 1
                # One row for each word of a text, with how often it stands there.
                order = np.lexsort((p.hashes[may], of))
                may, of = may[order], of[order]
                new = np.ones(len(may), bool)
                new[1:] = (of[1:] != of[:-1]) | (p.hashes[may[1:]] != p.hashes[may[:-1]])
                at = np.flatnonzero(new)
                times, may, of = np.diff(np.append(at, len(may))), may[at], pa.array(of[at] + p.number)
                words = [p.data[s:e] for s, e in zip(p.start[may].tolist(), p.end[may].tolist(), strict=True)]
                yield batches({"doc_id": (ids.take(here), pa.int64()), "t": (keys.take(here), pa.int64()), "word": ([None] * len(n), pa.binary()), "n": (n, pa.int64())})
                yield batches({"doc_id": (ids.take(of), pa.int64()), "t": (keys.take(of), pa.int64()), "word": (words, pa.binary()), "n": (times, pa.int64())})

    found = written(rows.select("doc_id", "t", "text").mapInArrow(hits, "doc_id long, t long, word binary, n long"), "toxic-hits")
    once = found.where("word is not null").groupBy("doc_id", "t", "word").agg(F.max("n").alias("n"))  # rows may be repeated
    sums = once.join(lexicon, "word").groupBy(F.col("doc_id").alias("d"), F.col("t").alias("k")).agg(F.sum(F.col("n") * F.col("evidence")).alias("sum"))
    every = found.where("word is null").select("doc_id", "t", "n")
    every = every.join(written(sums, "toxic-sums"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("k")), "left")
    return every.select("doc_id", "t", F.coalesce(F.col("sum") / F.sqrt(F.greatest("n", F.lit(1))), F.lit(0.0)).alias("raw"))


def _fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def _keyed(docs: DataFrame) -> DataFrame:
    return text_rows(docs).withColumn("t", F.xxhash64("text"))


def train(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, tuple[float, float]]:
    """The ratios learnt from the rows whose crc32(doc_id as text) mod 5 is not 0, and the curve,
    which is fitted on fold 4 by the counts of the other folds. A doc_id labelled more
    than once is toxic if any row says so; null labels and ids count as unlabelled."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    marks = written(marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(_fold() != TEST_FOLD), "toxic-labels")
    mine = only_in_bitmap(text_rows(docs), "doc_id", key_bitmap(marks, "doc_id")).join(marks, "doc_id")
    kind = F.when(F.col("toxic") > 0, 1).otherwise(0) + F.when(_fold() == CURVE_FOLD, 2).otherwise(0)
    counted = mine.select("text", kind.alias("kind")).mapInArrow(_count_words, "word binary, c0 long, c1 long, c2 long, c3 long")
    words = written(counted.groupBy("word").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(4)]), "words")
    first = train_ratios(words.where("c0 + c1 > 0").select("word", "c0", "c1"))
    ids = marks.where(_fold() == CURVE_FOLD)
    # More than the labelled rows may get through; they meet their labels when scored.
    held = only_in_bitmap(_keyed(docs).where(_fold() == CURVE_FOLD), "doc_id", key_bitmap(ids, "doc_id"))
    raw = raw_scores(held, evidence(written(distinct_words(held), "curve-words"), first))
    curve = fitted_curve(raw.join(ids, "doc_id").select("raw", "toxic"))
    return train_ratios(words.select("word", (F.col("c0") + F.col("c2")).alias("c0"), (F.col("c1") + F.col("c3")).alias("c1"))), curve


def _scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, t, score), one row per row of docs."""
    model, (slope, bias) = train(docs, labels)
    rows = _keyed(docs)
    raw = raw_scores(rows, evidence(written(distinct_words(rows), "all-words"), model))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("raw") * slope + bias))))
    return raw.select("doc_id", "t", score.alias("score"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that score under 0.5; as toxicity()."""
    gone = written(_scored(docs, labels).where("score >= 0.5").select(F.col("doc_id").alias("d"), F.col("t").alias("k")).distinct(), "toxic-rows")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("d")) & (F.xxhash64(empty_text("row.text")) == F.col("k"))
    return rows.join(gone, same, "left_anti").select("row.*")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs.

    A null text counts as empty and scores the curve's value at no evidence, as does any
    text without letters or digits. Rows with a null doc_id are scored and not held out;
    repeated rows score the same. Without labelled rows of both classes every score is
    the (smoothed) share of toxic labels. Other columns are not read.
    """
    held = F.coalesce(_fold() == TEST_FOLD, F.lit(False))
    return _scored(docs, labels).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
