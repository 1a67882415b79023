"""N-gram Jaccard join on a count-vector R-tree.

Documents with equal shingle sets form a class, and classes are joined. Exact filters cut
the classes into small candidate groups first; inside a group (or a pair of chunks of a
large one) the shingles are hashed into groups, the counts per group are points in an
R-tree, the overlap with a node or a point is bounded by the summed coordinate minima,
and what survives the bound is verified on the sets. No link between classes is lost:

* t(n) = ceil(0.75 n) shared shingles are the least that a set of n needs for any link.
* Prefix lemma: in any common order of shingles, linked sets share l of their first
  n - t + l ones. A class whose first ones (by hash) are found in too few other classes
  can't link and goes.
* Among the rest the order is by document frequency, rarest first, so that a passage
  which many documents hold comes last; classes that share one of their first
  n - t + 1 shingles land in the same candidate group.

Pairs are never written out: a task returns, per class, how many documents it links with
and one edge towards its component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, components, in_bitmap, key_bitmap, lean, shingle_set, text_rows, written

SHINGLE, PERCENT = 5, 75
#: Coordinates of a point, entries of a node, and the most classes and shingles of a chunk.
GROUPS, FANOUT, CHUNK_CLASSES, CHUNK_SHINGLES = 32, 16, 1024, 2_000_000
EMIT = 1 << 18


def least_overlap(n: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """ceil(percent/100 * n)"""
    return (n * percent + 99) // 100


def depth(n: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """l of the prefix lemma, as a third of the least overlap."""
    return np.maximum(1, least_overlap(n, percent) // 3)


def class_key(shingles: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _sets(rows: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
    for b in rows:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            yield doc, shingle_set(text.as_buffer().to_pybytes().lower(), SHINGLE)


@lean
def _classes(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, n, c, c2) of (doc_id, text, text_key): set size and class key."""
    for b in rows:
        n, keys = [], []
        for _, s in _sets([b]):
            n.append(len(s)), keys.append(class_key(s) if len(s) else (None, None))
        yield batches({"doc_id": (b.column(0), pa.int64()), "text_key": (b.column(2), pa.int64()), "n": (n, pa.int64())} | {k: ([x[i] for x in keys], pa.int64()) for i, k in enumerate(("c", "c2"))})


@lean
def _prefixes(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, c) of each class that is new in this task: its first n - t + l shingles."""
    seen, tokens, keys, size = set(), [], [], 0

    def out() -> pa.RecordBatch:
        return batches({"token": (np.concatenate(tokens).view(np.int64), pa.int64()), "c": (np.concatenate(keys), pa.int64())})

    for _, s in _sets(rows):
        if not len(s) or (key := class_key(s)) in seen:
            continue
        seen.add(key)
        n = len(s)
        first = s[: n - least_overlap(n) + depth(n)]
        tokens.append(first), keys.append(np.full(len(first), key[0], np.int64))
        size += len(first)
        if size >= EMIT:
            yield out()
            tokens, keys, size = [], [], 0
    if tokens:
        yield out()


@lean
def _tokens(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, c) of whole sets."""
    for b in rows:
        for c, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            token = np.frombuffer(s.as_buffer(), np.int64)
            yield batches({"token": (token, pa.int64()), "c": (np.full(len(token), c, np.int64), pa.int64())})


class CountTree:
    """R-tree, packed bottom up, over points of shingle counts per group. Only the upper
    corners of the boxes matter: the sum over coordinates of min(query, corner) bounds
    the overlap of the query with whatever lies in the box."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fanout: int = FANOUT):
        self.order = np.lexsort((*points.T[:4], sizes))
        self.levels, self.fanout = [(points[self.order], sizes[self.order], sizes[self.order])], fanout
        while len(self.levels[-1][0]) > fanout:
            corner, low, high = self.levels[-1]
            at = np.arange(0, len(corner), fanout)
            self.levels.append((np.maximum.reduceat(corner, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def query(self, point: np.ndarray, size: int, percent: int = PERCENT) -> np.ndarray:
        """Numbers of the points whose bound allows a link."""
        at = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            corner, low, high = (x[at] for x in self.levels[k])
            bound = np.minimum(corner, point).sum(1, dtype=np.int64)
            at = at[((100 + percent) * bound >= percent * (size + low)) & (100 * high >= percent * size) & (percent * low <= 100 * size)]
            if k:
                at = (at[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                at = at[at < len(self.levels[k - 1][0])]
        return self.order[at]


def count_points(sets: list[np.ndarray], groups: int = GROUPS) -> np.ndarray:
    return np.stack([np.bincount((s % np.uint64(groups)).astype(np.int64), minlength=groups) for s in sets])


def links(sets: list[np.ndarray], ask: np.ndarray, held: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray]]:
    """For each number in ask, the numbers in held (not itself) that it links with."""
    tree = CountTree(count_points([sets[i] for i in held]), np.array([len(sets[i]) for i in held]))
    points = count_points([sets[i] for i in ask])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    start = np.cumsum(sizes) - sizes
    mark = np.zeros(code.max(initial=0) + 1, bool)
    for q, point in zip(ask, points, strict=True):
        near = held[tree.query(point, sizes[q], percent)]
        near = near[near != q]
        if not len(near):
            continue
        own = code[start[q] : start[q] + sizes[q]]
        mark[own] = True
        n = sizes[near]
        at = np.repeat(start[near] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.add.reduceat(mark[code[at]].astype(np.int64), np.cumsum(n) - n)
        mark[own] = False
        yield q, near[100 * both >= percent * (n + sizes[q] - both)]


def _join_chunks(group: pa.Table) -> pa.Table:
    """Link counts and component edges of one pair of chunks."""
    c, weight = (group[k].to_numpy() for k in ("c", "docs"))
    mine, pair = (group[k].combine_chunks() for k in ("mine", "pair"))
    own = list(zip(*(mine.field(k).to_numpy() for k in ("band", "side")), strict=True))
    i, j = (tuple(pair[0][k].as_py().values()) for k in ("i", "j"))
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in group["shingles"]]
    ask, held = (np.array([k for k, x in enumerate(own) if x == side], np.int64) for side in (i, j))
    linked, root = np.zeros(len(c), np.int64), np.arange(len(c))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    if len(ask) and len(held):
        for q, near in links(sets, ask, held):
            linked[q] += weight[near].sum()
            if i != j:
                linked[near] += weight[q]
            for x in near:
                a, b = find(q), find(x)
                root[max(a, b)] = min(a, b)
    top = c[[find(x) for x in range(len(c))]] if len(c) else c
    return pa.table({"c": pa.array(c), "root": pa.array(top), "linked": pa.array(linked)})


def jaccard_join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links, text_key, component_key), one
    row per row of docs.

    Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z. A set
    holds the distinct 5-word shingles; with fewer words the whole sequence is the one
    shingle. Texts that are null, empty or blank have no shingles and link with nothing:
    their component and class are their own doc_id. component_id and class_id are the
    smallest doc_ids reachable and of an equal set; n_links counts the other rows that
    link with this one. Rows with a null doc_id take part but name no component unless
    they are alone; repeated rows are separate rows of one class. text_key is a hash of the
    text and component_key one that the rows of a component share, null without shingles.
    An empty table gives an empty result; other columns are not read.
    """
    rows = text_rows(docs)
    spark = docs.sparkSession
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    mine = written(keyed.mapInArrow(_classes, "doc_id long, text_key long, n long, c long, c2 long"), "jaccard-classes")
    classes = mine.where("n > 0").groupBy("c", "c2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("docs"), F.max("n").alias("n"))
    # Below, a class is named by c, or where two classes have the same c, by a hash of both.
    clash = mine.where("n > 0").groupBy("c").agg((F.min("c2") < F.max("c2")).alias("clash")).where("clash")
    classes = classes.join(clash, "c", "left").withColumn("u", F.when(F.col("clash"), F.xxhash64("c", "c2")).otherwise(F.col("c")))
    classes = written(classes, "jaccard-class-sizes")

    owners = rows.mapInArrow(_prefixes, "token long, c long").groupBy("token").agg(F.min("c").alias("c"), F.max("c").alias("last"))
    alone = owners.where("c = last").groupBy("c").agg(F.count("*").alias("alone"))
    t = f"((n * {PERCENT} + 99) div 100)"
    least = f"greatest(1, (({t} * {PERCENT} + 99) div 100) div 3)"
    may = classes.join(alone, "c", "left").where(f"clash or n - {t} + greatest(1, {t} div 3) - coalesce(alone, 0) >= {least}")
    may = written(may.select("c", "c2", "u", "class_id", "docs", "n"), "jaccard-survivors")

    keep = spark.sparkContext.broadcast(key_bitmap(may, "c"))

    @lean
    def survivors(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in it:
            found = {}
            for _, s in _sets([b]):
                if len(s) and (key := class_key(s)) not in seen:
                    seen.add(key)
                    if in_bitmap(keep.value, np.array([key[0]]))[0]:
                        found[key] = s.tobytes()
            yield batches({"c": ([k[0] for k in found], pa.int64()), "c2": ([k[1] for k in found], pa.int64()), "shingles": (list(found.values()), pa.binary())})

    sets = rows.mapInArrow(survivors, "c long, c2 long, shingles binary").join(may.select("c", "c2", "u", "docs", "n"), ["c", "c2"])
    sets = written(sets.dropDuplicates(["c", "c2"]).select(F.col("u").alias("c"), "docs", "n", "shingles"), "jaccard-sets")

    token = sets.select("c", "shingles").mapInArrow(_tokens, "token long, c long")
    several = token.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = token.join(several, "token").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared")).join(sets.select("c", "n"), "c")
    first = ranked.where(f"size(shared) >= {t}").select("c", F.explode(F.expr(f"slice(shared, 1, cast(n - {t} + 1 - (n - size(shared)) as int)).token")).alias("token"))
    first = written(first, "jaccard-first")
    stars = first.join(first.groupBy("token").agg(F.min("c").alias("low"), F.count("*").alias("k")).where("k > 1"), "token")
    groups = components(stars.select(F.col("c").alias("a"), F.col("low").alias("b")))

    member = sets.join(groups.select(F.col("node").alias("c"), F.col("component").alias("g")), "c")
    found = written(_dealt(written(member, "jaccard-members")).groupBy("g", "pair").applyInArrow(_join_chunks, "c long, root long, linked long"), "jaccard-links")

    reach = components(found.select(F.col("c").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "u", "component": "top"})
    linked = found.groupBy(F.col("c").alias("u")).agg(F.sum("linked").alias("linked"))
    known = may.select("c", "c2", "u", "class_id", "docs").join(reach, "u", "left").join(linked, "u", "left")
    known = known.withColumn("top", F.coalesce("top", "u"))
    smallest = known.groupBy("top").agg(F.min("class_id").alias("component_id"))
    known = known.join(smallest, "top").select("c", "c2", "component_id", "top", "linked")
    # Written, so that the rows of a class of very many copies can be split in the last join.
    info = written(classes.select("c", "c2", "u", "class_id", "docs").join(known, ["c", "c2"], "left"), "jaccard-info")
    in_class = mine.where("n > 0").join(info, ["c", "c2"]).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "class_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"),
        (F.col("docs") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "text_key", F.coalesce("top", "u").alias("component_key"),
    )
    blank = mine.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"),
        F.lit(0).cast("long").alias("n_links"), "text_key", F.lit(None).cast("long").alias("component_key"),
    )
    return in_class.unionByName(blank)


def _dealt(member: DataFrame) -> DataFrame:
    """Rows of member(g, c, docs, n, shingles) once for each pair of chunks that they are
    in: (g, pair, mine, c, docs, shingles).

    Linked sets differ in size by a third at most. Classes of a large group are therefore
    put into bands of sizes, each a third wider than the one before, and a chunk meets only
    those of its own band and the two next to it."""
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK_CLASSES), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int")
    large = member.groupBy("g").agg(chunks.alias("all"))
    # The factor keeps rounding from parting sizes that differ by a third exactly.
    band = F.when(F.col("all") == 1, 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / math.log(100 / PERCENT) * (1 - 1e-9))).cast("int")
    member = member.join(large, "g").withColumn("band", band)
    sized = member.groupBy("g", "band").agg(chunks.alias("k"))
    beside = sized.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("band", "k"))).alias("bands"))
    at = member.join(beside, "g").withColumns({f"k{d}": F.coalesce(F.try_element_at("bands", F.col("band") + d), F.lit(0)) for d in (-1, 0, 1)} | {"mine": F.struct("band", F.pmod(F.xxhash64("c"), F.try_element_at("bands", F.col("band"))).cast("int").alias("side"))})
    pair = "named_struct('i', {}, 'j', {})"
    other = "named_struct('band', band + {}, 'side', o)"
    some = "if({0} > 0, transform(sequence(0, {0} - 1), o -> {1}), array())"
    met = [
        some.format("`k0`", pair.format(f"least(mine, {other.format(0)})", f"greatest(mine, {other.format(0)})")),
        some.format("`k1`", pair.format("mine", other.format(1))), some.format("`k-1`", pair.format(other.format(-1), "mine")),
    ]
    dealt = at.select("g", "c", "docs", "shingles", "mine", F.explode(F.expr(f"concat({', '.join(met)})")).alias("pair"))
    return dealt.repartition("g", "pair")  # else all chunks of a group stay where its join by g left them
