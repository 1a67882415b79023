"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

Text is marked as SentencePiece does (every space becomes the mark, one more in front)
and cut before each run of marks; no piece reaches over such a cut, so the best path of a
text is that of its words. The distinct words of a batch are sorted, which walks their
trie depth-first: the forward scores of a word's prefix that it shares with the word
before it are kept on a stack and only the rest is searched.

The pieces and their scores are read from a model file, whose path is a parameter. A
model's pieces are taken as a unigram vocabulary: the encoding is the path of the highest
total score, characters without a piece falling back to byte pieces.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, shared, text_rows

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words whose encodings a task remembers at once.
REMEMBERED = 300_000


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of a protocol buffer message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    at = 0
    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            value, at = data[at : at + n], at + n
        yield tag >> 3, kind, value


@dataclass
class Pieces:
    """A vocabulary: piece -> (id, score), ids of the byte pieces, pieces by id."""

    by_piece: dict[str, tuple[int, float]]
    by_byte: dict[int, int]
    by_id: list[tuple[str, int]]
    unknown: int
    #: Score of a character that falls back: below that of any piece.
    fallback: float = 0.0
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)
    raw: list[bytes] = field(default_factory=list)
    #: Scores of the pieces and, as minus infinity, of all that a piece can end with.
    tails: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for piece in self.by_piece:
            for k in range(1, len(piece)):
                self.tails.setdefault(piece[k:], float("-inf"))
        self.tails.update((p, s) for p, (_, s) in self.by_piece.items())
        text = {NORMAL: lambda p: p.replace(MARK, " "), USER: lambda p: p.replace(MARK, " "), UNKNOWN: lambda _: " ⁇ "}
        self.raw = [bytes([int(p[1:-1], 16)]) if k == BYTE else text.get(k, lambda _: "")(p).encode() for p, k in self.by_id]

    @classmethod
    def read(cls, model: bytes) -> Pieces:
        by_piece, by_byte, by_id, unknown = {}, {}, [], 0
        for number, _, value in _fields(model):
            if number != 1:
                continue
            piece, score, kind = "", 0.0, NORMAL
            for n, _, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            if kind in (NORMAL, USER):
                by_piece[piece] = (len(by_id), score)
            elif kind == BYTE:
                by_byte[int(piece[1:-1], 16)] = len(by_id)
            elif kind == UNKNOWN:
                unknown = len(by_id)
            by_id.append((piece, kind))
        # A piece with a mark behind another character would reach over a cut.
        across = [p for p in by_piece if MARK in p.lstrip(MARK)]
        if across:
            raise ValueError(f"pieces that reach over words: {across[:3]}")
        scores = [s for _, s in by_piece.values()]
        return cls(by_piece, by_byte, by_id, unknown, min(scores, default=0.0) - 10)

    def _bytes(self, char: str) -> tuple[int, ...]:
        if len(self.by_byte) == 256:
            return tuple(self.by_byte[b] for b in char.encode("utf-8", "surrogatepass"))
        return (self.unknown,)

    def search(self, words: Iterable[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """The best path of each of the sorted distinct words."""
        by_piece, tails, fallback = self.by_piece, self.tails, self.fallback
        last, score, back = "", [0.0], [0]
        for word in words:
            common, most = 0, min(len(last), len(word))
            while common < most and last[common] == word[common]:
                common += 1
            del score[common + 1 :], back[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                best, start = score[end - 1] + fallback, end - 1
                for i in range(end - 1, -1, -1):
                    own = tails.get(word[i:end])
                    if own is None:  # no piece ends like this
                        break
                    if score[i] + own >= best:  # of equal scores the longer last piece
                        best, start = score[i] + own, i
                score.append(best)
                back.append(start)
            last, end, path = word, len(word), []
            while end:
                start = back[end]
                hit = by_piece.get(word[start:end])
                path.append((hit[0],) if hit else self._bytes(word[start:end]))
                end = start
            yield word, tuple(i for ids in reversed(path) for i in ids)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [_WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self.known
        known.update(self.search(sorted({w for ws in split for w in ws} - known.keys())))
        return [np.array(list(chain.from_iterable(map(known.__getitem__, ws))), np.int32) for ws in split]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: byte pieces joined into characters, marks back into spaces,
        the one in front taken off."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def _load(path: str) -> Pieces:
    with open(path, "rb") as f:
        return Pieces.read(f.read())


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip), one row per row of docs.

    round_trip tells whether decode(ids) is the text again; it is false only for texts
    that hold the mark U+2581 itself, which SentencePiece too decodes as a space. A null
    text counts as empty and has no ids. Whole texts are encoded; repeated rows encode
    alike; null ids are passed on; an empty table gives none; other columns are not read.
    The vocabulary (of the size that the model file has) is read by the driver.
    """
    rows = text_rows(docs)
    get = shared(docs.sparkSession, _load(model))

    @lean
    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = get()
        for b in it:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                texts = part.column(1).to_pylist()
                ids = pieces.encode_batch(texts)
                same = [pieces.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]
                size = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(size), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""
    get = shared(encoded.sparkSession, _load(model))

    @lean
    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [None if x is None else get().decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
