"""What several operators share: the shared scratch folder, filters of a fixed size,
connected components and the word rules."""

from __future__ import annotations

import atexit
import ctypes
import pickle
import re
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from dataclasses import dataclass
from functools import wraps
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

# Functions sent to executors travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])

#: Buckets of a key bitmap: a prime near 2**23, so a bitmap takes 1 MB whatever the input.
BITMAP = 8_388_593

class Scratch:
    """The scratch tables that operators wrote inside `with scratch(spark) as made:`.

    Results are lazy and read those tables, so the caller says when they are done with:
    made.delete() removes the tables of this scope and no others."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def delete(self) -> None:
        while self.paths:
            delete(self.spark, self.paths.pop())


_SCOPE: ContextVar[Scratch | None] = ContextVar("stratalog-scratch", default=None)
_OWN_FOLDER: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    made = Scratch(spark)
    before = _SCOPE.set(made)
    try:
        yield made
    finally:
        _SCOPE.reset(before)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset,
    a session on one machine (as in tests) gets a folder of its own until the process
    ends; on a cluster there is no folder that would do."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="stratalog-"))
        atexit.register(shutil.rmtree, _OWN_FOLDER[0], ignore_errors=True)
    return f"file://{_OWN_FOLDER[0]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_folder(spark)}/stratalog/{name}-{uuid.uuid4().hex}"
    if made := _SCOPE.get():
        made.paths.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back. A lost
    executor then costs no more than the tasks it ran."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession, value: T) -> Callable[[], T]:
    """Broadcast any value; classes travel with it, by value."""
    sent, here = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get() -> T:
        if not here:
            here.append(pickle.loads(sent.value))
        return here[0]

    return get


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def lean(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """f, after which the worker gives the memory that it no longer needs back to the
    system: workers wait for their next task, some of them beside busy ones."""

    @wraps(f)
    def run(*args, **more) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from f(*args, **more)
        finally:
            with suppress(AttributeError, OSError):  # a system without malloc_trim
                _trim()

    return run


def empty_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), so that no other column of docs can clash with ours."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), empty_text(text_col).alias("text"))


def batches(columns: dict[str, tuple[list | np.ndarray, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in columns.values()], names=list(columns))


def key_bitmap(df: DataFrame, key: str, size: int = BITMAP) -> np.ndarray:
    """Bits set at key mod size, as uint64 words. At most size / 64 rows come to the
    driver. A clear bit proves a key absent; a set one proves nothing, so it may only
    spare work before an exact join: when it fills up, the join does all the work."""
    at = F.expr(f"pmod({key}, {size}L)")
    rows = (
        df.where(F.col(key).isNotNull())
        .select(at.alias("p"))
        .groupBy(F.expr("p div 64").alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits"))
        .toArrow()
    )
    words = np.zeros(size // 64 + 1, np.int64)
    words[rows["w"].to_numpy()] = rows["bits"].to_numpy()
    return words.view(np.uint64)


def in_bitmap(words: np.ndarray, keys: np.ndarray, size: int = BITMAP) -> np.ndarray:
    at = keys.astype(np.int64) % size
    return (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


def only_in_bitmap(df: DataFrame, key: str, words: np.ndarray) -> DataFrame:
    """The rows of df whose key may be in the bitmap; null keys go."""
    shared = df.sparkSession.sparkContext.broadcast(words)

    @lean
    def keep(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            k = b.column(b.schema.get_field_index(key))
            hit = in_bitmap(shared.value, k.fill_null(0).to_numpy(zero_copy_only=False))
            yield b.filter(pa.array(hit & ~k.is_null().to_numpy(zero_copy_only=False)))

    return df.mapInArrow(keep, df.schema)


#: Into how many parts the rows of one key are dealt.
SALTS = 16


def looked_up(rows: DataFrame, small: DataFrame, key: str, by: str) -> DataFrame:
    """rows with the columns of small(key, ...), null where it has no such key. The rows of
    a very common key are dealt out by a hash of `by`, small being repeated for each part;
    keep small to the keys that need it."""
    dealt = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(dealt, [key, "_part"], "left").drop("_part")


#: Edges up to which one task finishes the components (16 MB); beyond, star rounds go on.
ONE_TASK_EDGES = 1_000_000


@lean
def _union(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    schema = None
    for b in rows:
        schema = b.schema
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            p, q = find(u), find(v)
            root[max(p, q)] = min(p, q)
    if root:
        nodes = list(root)
        for i in range(0, len(nodes), 50_000):
            part = nodes[i : i + 50_000]
            yield batches({"node": (part, schema.field(0).type), "component": ([find(x) for x in part], schema.field(0).type)})


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task_edges: int | None = None, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each written to
    the shared folder. A round is two aggregations with map-side combining and two joins
    whose large side Spark may split, so no node's neighbours meet in one task. Only where
    the counted edges are few does one task finish by union-find.
    """
    few = ONE_TASK_EDGES if one_task_edges is None else one_task_edges
    e = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    kind = e.schema["u"].dataType.simpleString()
    seen = None
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now[0] <= few:
            return e.coalesce(1).mapInArrow(_union, f"node {kind}, component {kind}")
        if now == seen:
            break
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        e = written(small.distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    stars = e.groupBy("u").agg(F.min("v").alias("m"))
    return stars.select(F.col("u").alias("node"), F.col("m").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


#: 1 for the bytes that part words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(1, 2**62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_POWERS: dict[int, np.ndarray] = {}


def kept_powers(base: int, n: int) -> np.ndarray:
    """powers(base, n), kept in the process."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = powers(base, max(n, 1 << 16))
    return _POWERS[base][:n]


#: Bytes whose words are hashed at once.
PIECE = 1 << 18
_GAP = re.compile(rb"[\x20\x09-\x0d]")


def words_at(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end) of each word of bytes, in order: differences of the prefix
    sums of byte values times powers, brought to a common power."""
    if len(data) > PIECE:
        found, a = [], 0
        while a < len(data):
            gap = _GAP.search(data, a + PIECE)
            b = gap.start() if gap else len(data)
            h, start, end = _words_at(data[a:b])
            found.append((h, start + a, end + a))
            a = b
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    return _words_at(data)


def _words_at(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~SPACE[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * kept_powers(_BASE, len(raw)), out=total[1:])
    back = kept_powers(_BASE_INVERSE, len(raw) + 1)
    return mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64)), start, end


def word_hashes(data: bytes) -> np.ndarray:
    return words_at(data)[0]


@dataclass
class Piece:
    """Some texts together: the number of the first, their bytes, each word's hash, first
    byte and end, and the place of each text's first word, and of the end."""

    number: int
    data: bytes
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def text_pieces(texts: list | pa.Array, plain: Callable[..., bytes]) -> Iterator[Piece]:
    """Texts made plain and put together until they reach a size; a longer one is alone."""
    held, size, number = [], 0, 0
    each = texts if isinstance(texts, list) else (x for i in range(0, len(texts), 256) for x in texts.slice(i, 256).to_pylist())
    for k, text in enumerate(each):
        held.append(plain(text))
        size += len(held[-1]) + 1
        if size >= PIECE or k == len(texts) - 1:
            data = b"\n".join(held)
            edge = np.concatenate(([0], np.cumsum([len(x) + 1 for x in held])))
            h, start, end = words_at(data)
            yield Piece(number, data, h, start, end, np.searchsorted(start, edge))
            held, size, number = [], 0, k + 1


def shingle_set(data: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of lower-cased bytes; with fewer
    words, of the whole sequence; without words, nothing."""
    h = word_hashes(data)
    if not len(h):
        return h
    if len(h) < k:
        return mixed((h * _STEP[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    s = h[: len(h) - k + 1] * _STEP[0]
    for i in range(1, k):
        s = s + h[i : len(h) - k + 1 + i] * _STEP[i]
    return np.unique(mixed(s + np.uint64(k)))
