"""Suffix-array deduplication of 50-byte strings.

Every byte goes that lies in a 50-byte string which also starts in a document with a
smaller doc_id. A suffix array of the whole corpus fits no task, so equal strings are
first brought together, exactly: each 50-byte window is filed under the smallest hash of
its 20-byte grams, and runs of windows with the same one form a segment. Equal windows
have the same file. Files of one document drop out; segments equal as a whole need no
sorting; the rest are concatenated per bucket of files, sorted by a two-stage suffix
array (directly only the suffixes smaller than their successors, the others induced by
bucket scans), and adjacent common prefixes of 50 bytes give the repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _BASE_INVERSE, _BYTE, batches, in_bitmap, kept_powers, key_bitmap, lean, mixed, only_in_bitmap, text_rows, written

LENGTH, GRAM = 50, 20
WINDOWS = LENGTH - GRAM + 1
#: Bits of a place in the bitmap of shared files (64 MB), text of one suffix array, and
#: segments of a file beyond which its windows are dealt out singly.
FILE_BITS, ARRAY_BYTES, HOT_FILE = 29, 2 << 20, 10_000
#: Segments sent at once, files noted at once, bytes of text whose files meet in a task, and
#: bytes of parts cut at once.
EMIT, NOTED, TASK_BYTES, CUT_BYTES = 1 << 17, 1 << 20, 16 << 20, 4 << 20

def segments(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(file, content hash, first window, windows) of each segment of a document."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) - LENGTH + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    up, down = (kept_powers(x, len(raw) + 1) for x in (_BASE, _BASE_INVERSE))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:-1], out=total[1:])
    least = mixed((total[GRAM:] - total[:-GRAM]) * down[: len(raw) - GRAM + 1])
    span = 1
    while 2 * span <= WINDOWS:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < WINDOWS:
        least = np.minimum(least[: len(least) - (WINDOWS - span)], least[WINDOWS - span :])
    start = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    count = np.diff(np.append(start, n))
    if count.max() > WINDOWS:  # the same gram again and again
        pieces = -(-count // WINDOWS)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(start, pieces) + nth * WINDOWS
        count = np.diff(np.append(start, n))
    end = start + count + LENGTH - 1
    return least[start], mixed((total[end] - total[start]) * down[start] + count.astype(np.uint64)), start, count


def _typed(text: np.ndarray) -> np.ndarray:
    """True for the suffixes smaller than their successors; the last one is not."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    smaller = np.zeros(n, bool)
    if len(differs):
        smaller[: differs[-1] + 1] = np.repeat(text[differs] < text[differs + 1], np.diff(differs, prepend=-1))
    return smaller


def _words(text: np.ndarray, n: int) -> np.ndarray:
    """The eight values from each of n places on as one number; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(n + 8 - len(text), np.uint8)])
    return np.ndarray(n, ">u8", padded, strides=(1,)).astype(np.uint64)


def suffix_array(text: np.ndarray, deep: int = 56) -> np.ndarray:
    """Starts of the suffixes of text (uint8) in the order of their first `deep` values
    at least; a multiple of 8."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    word = _words(text, n + deep)
    smaller = _typed(text)
    # Stage one: sort the suffixes that are smaller than their successors, word by word,
    # going on only with ties, of which only groups that are out of order move.
    order = np.flatnonzero(smaller)
    order = order[np.argsort(word[order])]
    new = np.ones(len(order), bool)
    new[1:] = word[order[1:]] != word[order[:-1]]
    for d in range(8, deep, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(new[at]) - 1
        own = order[at]
        value = word[own + d]
        together = group[1:] == group[:-1]
        down = np.flatnonzero(together & (value[1:] < value[:-1]))
        if len(down):
            moves = np.zeros(group[-1] + 1, bool)
            moves[group[down]] = True
            moved = np.flatnonzero(moves[group])
            by = moved[np.lexsort((value[moved], group[moved]))]
            own[moved], value[moved] = own[by], value[by]
            order[at] = own
        new[at[1:]] = ~(together & (value[1:] == value[:-1]))
    # Stage two: scan the buckets of first values upwards; each suffix places the one
    # before it, if that is greater than its successor, next in the bucket of its value.
    bounds = np.searchsorted(text[order], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    done = []

    def place(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        value = text[before]
        by = np.argsort(value, kind="stable")
        before, value = before[by], value[by]
        cut = np.flatnonzero(np.diff(value)) + 1
        for part in np.split(before, cut) if len(before) else ():
            waiting[text[part[0]]].append(part)

    place(np.array([n]))
    for c in range(256):
        while waiting[c]:
            now, waiting[c] = np.concatenate(waiting[c]), []
            done.append(now)
            place(now)
        sorted_part = order[bounds[c] : bounds[c + 1]]
        done.append(sorted_part)
        place(sorted_part)
    return np.concatenate(done)


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Lengths, up to most, of the common prefixes of the suffixes at a and b."""
    word = _words(text, len(text) + most)
    length, alive = np.full(len(a), most), np.arange(len(a))
    for k in range(0, most, 8):
        differ = word[a[alive] + k] ^ word[b[alive] + k]
        ends = differ != 0
        same = sum((differ[ends] < np.uint64(1 << 8 * j)).astype(np.int64) for j in range(1, 8))
        length[alive[ends]] = np.minimum(k + same, most)
        alive = alive[~ends]
        if not len(alive):
            break
    return length


def repeats(data: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of parts given by their bytes (uint8, one part after another), sizes and owners: the
    runs (part, first, count) of starts of 50-byte strings that also start in a part with a
    smaller owner. No byte of a part may be 0xFF (there is none in UTF-8)."""
    first = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(len(data) + len(sizes), bool)
    inside[first + sizes] = False
    text = np.zeros(len(inside), np.uint8)  # 0 parts them
    text[inside] = data + np.uint8(1)
    part_at = np.repeat(np.arange(len(sizes)), sizes + 1)
    starts = np.arange(len(text)) <= (first + sizes - LENGTH)[part_at]
    array = suffix_array(text)
    array = array[starts[array]]
    if not len(array):
        return array, array, array
    new = np.concatenate(([True], common_prefixes(text, array[:-1], array[1:]) < LENGTH))
    own = owner[part_at[array]]
    lowest = np.minimum.reduceat(own, np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = np.zeros(len(text), bool)
    hit[array[lowest < own]] = True
    at, count = _runs(np.flatnonzero(hit))  # parts end with places that are no starts
    return part_at[at], at - first[part_at[at]], count


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct starts as (first, count) runs."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    first = starts[np.concatenate(([0], cut))]
    return first, np.diff(np.concatenate(([0], cut, [len(starts)])))


def _unseen(rows: Iterable[pa.RecordBatch], reps: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(doc_id, t, text) of the texts of 50 bytes or more, but of those that the task has
    read with a smaller id."""
    seen: dict[int, int] = {}
    for b in rows:
        docs, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
        for i in np.flatnonzero(in_bitmap(reps, docs)):
            doc, key, data = docs[i], keys[i], b.column(2)[int(i)].as_buffer().to_pybytes()
            if len(data) >= LENGTH and seen.setdefault(key, doc) >= doc:
                seen[key] = doc
                yield doc, key, data


def _ends(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, with their smallest and largest doc."""
    order = np.argsort(key)
    key, doc = key[order], doc[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[start], np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)


@lean
def _files(rows: Iterable[pa.RecordBatch], reps: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """(p, part): the files of the segments, as spread keys and then the documents of each,
    by the first bits of the key. Of a file's documents read at once, the smallest and the
    largest are sent."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        key, low, high = _ends(mixed(np.concatenate([h for h, _ in held])), np.repeat([d for _, d in held], [len(h) for h, _ in held]))
        times = 1 + (low != high)
        doc = np.repeat(low, times)
        doc[np.cumsum(times) - 1] = high
        key = np.repeat(key, times)
        edge = np.searchsorted(key >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else np.array([0, len(key)])
        some = np.flatnonzero(np.diff(edge))
        parts = [key[edge[p] : edge[p + 1]].tobytes() + doc[edge[p] : edge[p + 1]].tobytes() for p in some]
        return batches({"p": (some, pa.int64()), "part": (parts, pa.binary())})

    for doc, _, data in _unseen(rows, reps):
        held.append((segments(data)[0], doc))
        size += len(held[-1][0])
        if size >= NOTED:
            yield out()
            held, size = [], 0
    if held:
        yield out()


@lean
def _shared_files(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, bits) of (p, part): the words of the bitmap that has the files of two or more
    documents, sorted and packed. All files of a word have the same p."""
    found = [np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1) for b in rows for x in b.column(1)]
    if found:
        key, low, high = _ends(*(np.concatenate([f[k] for f in found]) for k in (0, 1)))
        del found
        at = np.sort(key[low < high].view(np.uint64)) >> np.uint64(64 - FILE_BITS)
        if len(at):
            word = at >> np.uint64(6)
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start)
            packed = pa.compress(np.diff(word[start].astype(np.uint32), prepend=np.uint32(0)).tobytes(), codec="zstd", asbytes=True)
            yield batches({"k": ([len(start)], pa.int64()), "w": ([packed], pa.binary()), "bits": ([pa.compress(bits.tobytes(), codec="zstd", asbytes=True)], pa.binary())})


def shared_files(known: DataFrame, reps: Broadcast, n_bytes: int) -> np.ndarray:
    """The bitmap of the files with segments of two or more documents: a clear bit proves
    that a file is not shared. (file, document) pairs travel as few large rows, so many
    parts of the files to each task that these are about even."""
    tasks = max(1, n_bytes // TASK_BYTES)
    bits = min(FILE_BITS - 6, (4 * tasks - 1).bit_length())
    noted = known.mapInArrow(lambda it: _files(it, reps.value, bits), "p long, part binary").repartition(tasks, "p")
    words = np.zeros(1 << FILE_BITS - 6, np.uint64)
    got = noted.mapInArrow(_shared_files, "k long, w binary, bits binary").toArrow()
    for k, w, b in zip(got["k"].to_pylist(), got["w"], got["bits"], strict=True):
        at = np.cumsum(np.frombuffer(pa.decompress(w.as_buffer(), 4 * k, codec="zstd"), np.uint32), dtype=np.uint32)
        words[at] = np.frombuffer(pa.decompress(b.as_buffer(), 8 * k, codec="zstd"), np.uint64)
    return words


@lean
def _emit(rows: Iterable[pa.RecordBatch], reps: np.ndarray, files: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(h, s, doc_id, t, lo, n) of the segments whose file may be shared."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        return batches({k: (c.view(np.int64), pa.int64()) for k, c in zip(("h", "s", "doc_id", "t", "lo", "n"), cols, strict=True)})

    for doc, key, data in _unseen(rows, reps):
        h, s, lo, n = segments(data)
        at = mixed(h) >> np.uint64(64 - FILE_BITS)
        k = np.flatnonzero((files[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))
        held.append((h[k], s[k], np.full(len(k), doc), np.full(len(k), key), lo[k], n[k]))
        size += len(k)
        if size >= EMIT:
            yield out()
            held, size = [], 0
    if held:
        yield out()


@lean
def _match(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, s, doc_id) -> segments whose content is in a smaller document
    (whole), and of a file with several contents those of each content's smallest document
    (else). Between batches the running content's rows in its smallest document are
    carried, or one of them once they are sent."""
    names = ("h", "s", "doc_id", "t", "lo", "n")
    carried, sent, known_mixed = [np.zeros(0, np.int64)] * 6, False, False
    for b in rows:
        if not b.num_rows:
            continue
        old = len(carried[0])
        cols = [np.concatenate((x, c.to_numpy())) for x, c in zip(carried, b.columns, strict=True)]
        h, s, doc = cols[:3]
        new_file = np.concatenate(([True], h[1:] != h[:-1]))
        new = new_file | np.concatenate(([True], s[1:] != s[:-1]))
        start = np.flatnonzero(new)
        low = doc == doc[start][np.cumsum(new) - 1]
        file = np.cumsum(new_file) - 1
        mixed_file = np.bincount(file[start]) > 1
        if old and h[0] == h[old - 1] and known_mixed:
            mixed_file[0] = True
        send = low & mixed_file[file]
        if sent:
            send[:old] = False
        out = np.flatnonzero(~low | send)
        yield batches({k: (v[out], pa.int64()) for k, v in zip(names, cols, strict=True)} | {"whole": (~low[out], pa.bool_())})
        known_mixed = sent = bool(mixed_file[-1])
        keep = start[-1] + np.flatnonzero(low[start[-1] :])
        carried = [c[keep[:1] if sent else keep] for c in cols]


@lean
def _cut_segments(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket key, doc_id, t, lo, part) of the asked segments of each text; those of hot
    files window by window, filed by the hash of the window."""
    for b in rows:
        doc, t = (b.column(k).to_numpy() for k in (0, 1))
        text, asked = b.column(2), b.column(3)
        data, byte = np.frombuffer(text.buffers()[2] or b"", np.uint8), np.frombuffer(text.buffers()[1], np.int32)[text.offset :]
        place = asked.offsets.to_numpy()
        h, lo, n, hot = (c.to_numpy(zero_copy_only=False)[place[0] : place[-1]] for c in asked.values.flatten())
        times = np.where(hot, n, 1)
        of = np.repeat(np.arange(len(h)), times)
        row = np.repeat(np.arange(b.num_rows), np.diff(place))[of]
        lo = lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        size, key = np.where(hot, LENGTH, n + LENGTH - 1)[of], h[of]
        start, end = byte[row] + lo, np.cumsum(size)
        for i in np.flatnonzero(hot[of]):
            key[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + LENGTH], digest_size=8).digest(), "little", signed=True)
        cuts = np.unique(np.concatenate(([0], np.searchsorted(end, np.arange(CUT_BYTES, end[-1] if len(end) else 0, CUT_BYTES)), [len(of)])))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            z, here = size[low:high], slice(low, high)
            edge = np.concatenate(([0], np.cumsum(z)))
            at = np.repeat(start[here] - edge[:-1], z) + np.arange(edge[-1])
            part = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(data[at])])
            columns = {"h": key[here], "doc_id": doc[row[here]], "t": t[row[here]], "lo": lo[here]}
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in columns.values()), part], [*columns, "part"])


def _array_repeats(group: pa.Table) -> pa.Table:
    doc, t, lo = (group[k].to_numpy() for k in ("doc_id", "t", "lo"))
    parts = [c for c in group["part"].chunks if len(c)]
    edges = [np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1] for c in parts]
    data = [np.frombuffer(c.buffers()[2], np.uint8)[e[0] : e[-1]] for c, e in zip(parts, edges, strict=True)]
    part, first, count = repeats(np.concatenate(data), np.concatenate([np.diff(e) for e in edges]).astype(np.int64), doc)
    return pa.table({"doc_id": doc[part], "t": t[part], "lo": lo[part] + first, "n": count})


@lean
def _cut(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows:
        digest, removed, spans, sha = [], [], [], []
        for text, los, ns in zip(b.column(1), b.column(2), b.column(3), strict=True):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            lo, n = los.values.to_numpy(), ns.values.to_numpy()
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, lo, 1)
            np.add.at(edge, lo + n + LENGTH - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            first, count = _runs(np.flatnonzero(gone))
            digest.append(hashlib.sha256(data.tobytes()).hexdigest())
            removed.append(int(gone.sum()))
            spans.append([{"start": int(f), "end": int(f + c)} for f, c in zip(first, count, strict=True)])
            sha.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.string()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(sha, pa.string())], ["doc_id", "d", "n_removed", "spans", "kept_sha256"])


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256), one row per row of docs; spans
    are the maximal removed byte runs, end exclusive.

    Null texts count as empty. Rows with a null doc_id compare with nothing and stay
    whole. Rows with the same doc_id don't remove from each other. Texts under 50 bytes
    lose nothing; a copy of a text of a smaller doc_id loses all of it. An empty table
    gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = text_rows(docs).select("doc_id", F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text"))
    mine = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("d"))
    first = mine.groupBy("d").agg(F.min("doc_id").alias("low"))
    mine = written(mine.join(first, "d"), "suffix-docs")
    known = rows.where("doc_id is not null")
    reps = spark.sparkContext.broadcast(key_bitmap(mine.where("doc_id = low"), "doc_id"))

    total = mine.agg(F.sum("n_bytes")).first()[0] or 0
    held = spark.sparkContext.broadcast(shared_files(known, reps, total))
    found = known.mapInArrow(lambda it: _emit(it, reps.value, held.value), "h long, s long, doc_id long, t long, lo long, n long")
    found = found.repartition("h").sortWithinPartitions("h", "s", "doc_id").mapInArrow(_match, "h long, s long, doc_id long, t long, lo long, n long, whole boolean")
    found = written(found, "suffix-segments")

    asked = found.where("not whole")
    sizes = asked.groupBy("h").agg(F.count("*").alias("k"), F.sum(F.col("n") + LENGTH - 1).alias("b"))
    hot = sizes.where(F.col("k") > HOT_FILE).select("h", F.lit(True).alias("hot"))
    total = sizes.agg(F.sum(F.when(F.col("k") > HOT_FILE, F.col("b") * WINDOWS).otherwise(F.col("b")))).first()[0] or 0
    arrays = max(1, -(-total // ARRAY_BYTES))
    per_doc = asked.join(hot, "h", "left").groupBy("doc_id", "t").agg(F.collect_list(F.struct("h", "lo", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("asked"))
    texts = only_in_bitmap(known, "doc_id", key_bitmap(asked, "doc_id")).dropDuplicates(["doc_id", "t"])
    parts = texts.join(per_doc, ["doc_id", "t"]).select("doc_id", "t", "text", "asked").mapInArrow(_cut_segments, "h long, doc_id long, t long, lo long, part binary")
    sorted_ = parts.groupBy(F.pmod(F.xxhash64("h"), F.lit(arrays)).alias("bucket")).applyInArrow(_array_repeats, "doc_id long, t long, lo long, n long")
    gone = written(sorted_.unionByName(found.where("whole").select("doc_id", "t", "lo", "n")), "suffix-repeats")

    per_doc = gone.groupBy("doc_id", "t").agg(F.collect_list("lo").alias("lo"), F.collect_list("n").alias("n"))
    texts = only_in_bitmap(known, "doc_id", key_bitmap(gone, "doc_id")).dropDuplicates(["doc_id", "t"])
    cut = texts.join(per_doc, ["doc_id", "t"]).select("doc_id", "text", "lo", "n")
    result = cut.mapInArrow(_cut, "doc_id long, d string, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string")
    copy = F.col("doc_id") > F.col("low")
    all_gone = copy & (F.col("n_bytes") >= LENGTH)
    none = F.expr("cast(array() as array<struct<start:long,end:long>>)")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return mine.join(result, ["doc_id", "d"], "left").select(
        "doc_id", "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(all_gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "d")).alias("kept_sha256"),
    )
