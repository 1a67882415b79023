"""Golden values and small cases."""

import re

import pytest
from pyspark.sql import functions as F
from stratalog import model
from stratalog.functions import cells as c
from stratalog.functions.tokens import bloom_size, crc32c, with_crc32c, with_token
from stratalog.operators import bloom, catalog, index, log, lookup, metrics, reconcile
from stratalog.plans import compaction

TOKENS = {
    "cassandra": 5199119324278033434, "kafka": -3073020021701925766, "clickhouse": 7207633386692605613, "a": -878198904293853608,
    "user:000001": 7406087873942824848, "user:500000": 4459946936191986567, "user:999999": -1547888018176513211, "aaa": 6559865031029512337,
    "zzz": -8716824341365713230, "": -7781342737886326986, "0123456789abcdef": 4693271450723296989, "0123456789abcdefXYZ": 3823988734037705644,
}
POOL = [0, 3, 16, 21, 11, 4, 12, 19, 18, 22, 20, 24, 14, 27, 9, 6, 29, 26, 28, 25, 1, 23, 17, 7, 8, 2, 10, 15, 5, 13]


@pytest.fixture(scope="module")
def make(spark):
    def cells(*rows):
        return spark.createDataFrame([(k, n, v, ts, f, ttl, i) for i, (k, n, v, ts, f, ttl) in enumerate(rows)], model.CELL)

    return cells


def files(spark, rows):
    """(file_id, level, size, low, high) as a catalog; positions in order."""
    full = [(i, lv, 100, 200, lo, "k" if lo is not None else None, hi, "k" if hi is not None else None, size, 0, p) for p, (i, lv, size, lo, hi) in enumerate(rows)]
    return spark.createDataFrame(full, "file_id long, level int, partition_count long, cell_count long, min_token long, min_key string, max_token long, max_key string, data_size_bytes long, created_at_ms long, catalog_pos int")


def test_tokens(spark):
    out = with_token(spark.createDataFrame([(k,) for k in TOKENS], "key string")).collect()
    assert {r.key: r.token for r in out} == TOKENS
    pool = with_token(spark.createDataFrame([(f"pool-key-{i}",) for i in range(30)], "key string")).orderBy("token", "key").collect()
    assert [int(r.key[9:]) for r in pool] == POOL
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_crc(spark):
    assert crc32c(b"123456789") == 0xE3069283
    rows = [b"123456789", b"", b"\x00" * 40, None]
    out = with_crc32c(spark.createDataFrame([(r,) for r in rows], "data binary"), "data").collect()
    assert [r.crc for r in out] == [crc32c(r or b"") for r in rows]


def test_bloom(spark):
    assert [bloom_size(n) for n in (1, 500, 1000, 10_000, 1_000_000)] == [(9, 6), (4792, 7), (9585, 7), (95850, 7), (9585058, 7)]
    own = with_token(spark.range(10_000).select(F.lit(1).cast("long").alias("file_id"), F.concat(F.lit("inserted-"), F.col("id")).alias("key")))
    other = with_token(spark.range(10_000).select(F.lit(1).cast("long").alias("file_id"), F.concat(F.lit("notinserted-"), F.col("id")).alias("key")))
    assert bloom.build(own).count() == 49_683
    assert bloom.probe(own, own).where("not might_contain").count() == 0
    assert bloom.probe(other, own).where("might_contain").count() == 107
    one = with_token(spark.createDataFrame([(1, "exists")], "file_id long, key string"))
    assert {r.bit for r in bloom.build(one).collect()} == {1, 4, 7}
    stray = with_token(spark.createDataFrame([(2, "x")], "file_id long, key string"))
    assert bloom.probe(stray, one).first().might_contain  # no filter, no verdict


def test_last_write_wins(make):
    got = lambda *rows: reconcile.memtable_merge(make(*rows)).first()
    assert got(("k", "c", "old", 100, 0, 0), ("k", "c", "new", 200, 0, 0)).value == "new"
    assert got(("k", "c", "new", 200, 0, 0), ("k", "c", "old", 100, 0, 0)).value == "new"
    assert got(("k", "c", "v", 100, 0, 0), ("k", "c", None, 200, 1, 0)).flags == 1
    assert got(("k", "c", None, 100, 1, 0), ("k", "c", "back", 200, 0, 0)).value == "back"
    assert got(("k", "c", "first", 100, 0, 0), ("k", "c", "second", 100, 0, 0)).value == "second"  # later arrival


def test_ties_of_a_compaction_go_to_the_earlier_input(make):
    cells = make(("k", "c", "a", 100, 0, 0), ("k", "c", "b", 100, 0, 0)).withColumn("input_pos", F.col("seq"))
    assert reconcile.compaction_merge(cells).first().value == "a"


def test_predicates(make):
    now = 10_000_000_000
    cells = make(("k", "a", None, now - 10_000_000, 1, 0), ("k", "b", "x", now - 5_000_000, 2, 5), ("k", "c", "x", now - 5_000_001, 2, 5), ("k", "d", "x", 0, 0, 0))
    name = lambda p: {r.name for r in cells.where(p).collect()}
    assert name(c.is_purgeable(now, 5)) == {"a"} and name(c.is_purgeable(now, 3600)) == set()
    assert name(c.is_expired(now)) == {"c"} and name(c.is_live(now)) == {"b", "d"}
    assert {r.name for r in reconcile.purge(cells, now).collect()} == {"b", "d"}
    assert tuple(reconcile.purged(cells, now).first()) == (2, 0)


def test_safe_purge_keeps_what_hides_older_data(spark, make):
    cells = with_token(make(("k", "a", None, 1, 1, 0), ("z", "a", None, 1, 1, 0)))
    at = {r.key: r.token for r in cells.collect()}
    outside = spark.createDataFrame([(at["k"], at["k"])], "min_token long, max_token long")
    assert [r.key for r in reconcile.purge_safe(cells, outside, 10**9).collect()] == ["k"]


def test_buckets(spark):
    sizes = [1024, 1100, 900, 100_000, 110_000]
    got = compaction.stcs_buckets(files(spark, [(i + 1, 0, s, 0, 1) for i, s in enumerate(sizes)])).collect()
    assert {r.file_id: r.bucket for r in got} == {3: 0, 1: 0, 2: 0, 4: 1, 5: 1}
    four = files(spark, [(i, 0, s, 0, 1) for i, s in enumerate([1024, 1000, 950, 1100, 90_000, 91_000])])
    assert compaction.stcs_select(compaction.stcs_buckets(four)).first().files == 4
    assert {r.file_id for r in compaction.SizeTiered().plan(four).collect()} == {0, 1, 2, 3}
    assert compaction.SizeTiered().plan(four.limit(0)).count() == 0
    many = files(spark, [(i, 0, 1000 + i, 0, 1) for i in range(40)])
    assert {r.file_id for r in compaction.SizeTiered().plan(many).collect()} == set(range(32))


def test_leveled_plans(spark):
    plan = lambda rows: {(r.file_id, r.output_level) for r in compaction.Leveled().plan(files(spark, rows)).collect()}
    assert plan([(i, 0, 1000, 0, 1) for i in range(4)]) == {(i, 1) for i in range(4)}
    assert plan([(i, 0, 1000, 0, 1) for i in range(3)]) == set()
    assert plan([(10, 1, 60_000, 0, 1), (11, 1, 60_000, 2, 3), (12, 1, 70_000, 4, 5)]) == {(12, 2)}
    assert plan([(1, 1, 200_000, 5, 8), (2, 2, 1, 7, 12), (3, 2, 1, 11, 15), (4, 2, 1, 20, 25)]) == {(1, 2), (2, 2), (3, 2)}
    assert plan([(1, 1, 200_000, 5, 8), (2, 2, 1, None, None), (4, 2, 1, 20, 25)]) == {(1, 2), (2, 2), (4, 2)}  # unknown bounds touch all
    targets = spark.createDataFrame([(i,) for i in range(6)], "level int").select(compaction.level_target(F.col("level")).alias("t")).collect()
    assert [r.t for r in targets] == [2**63 - 1, 131072, 1310720, 13107200, 131072000, 1310720000]


def test_conflicts(spark):
    rows = [(1, 1, 1, 0, 5), (2, 1, 1, 5, 9), (3, 1, 1, 10, 12), (4, 0, 1, 0, 99), (5, 2, 1, 0, 99)]
    assert [r.file_id for r in catalog.level_conflicts(files(spark, rows)).collect()] == [2]
    assert {(r.file_id, r.other_id) for r in catalog.overlaps(files(spark, rows)).collect()} == {(1, 2), (1, 4), (1, 5), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5)}


def test_sparse_index_starts_anew(spark):
    parts = spark.createDataFrame([(f, i, f"k{i}", s) for f in (1, 2) for i, s in enumerate([3000, 3000, 2000, 5000, 10, 10])], "file_id long, token long, key string, frame long")
    got = index.sparse_index(parts).where("file_id = 2").orderBy("entry").collect()
    assert [(r.token, r.data_offset) for r in got] == [(0, 13), (2, 6013), (3, 8013)]


def test_floor(spark):
    entries = spark.createDataFrame([(1, 10, "a", 100), (1, 20, "b", 200)], "file_id long, token long, key string, at long")
    keys = spark.createDataFrame([(1, 5, "x"), (1, 10, "a"), (1, 15, "y"), (1, 99, "z")], "file_id long, token long, key string")
    got = lambda **k: {r.key: r["at"] for r in index.floor(keys, entries, "at", **k).collect()}
    assert got() == {"x": None, "a": 100, "y": 100, "z": 200}
    assert got(else_first=True)["x"] == 100


@pytest.mark.parametrize("else_first", [False, True])
def test_floor_reads_a_file_once(spark, else_first):
    """No frame runs from a row to the end of its file: that takes the square of the keys."""
    n, first = 3000, 1000  # keys by file, and those before its first entry
    every = spark.range(n).withColumn("file_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    keys = every.select("file_id", F.col("id").alias("token"), F.concat(F.lit("k"), "id").alias("key"))
    entries = keys.where((F.col("token") >= first) & (F.col("token") % 7 == 0)).withColumn("at", F.col("token") * 10 + F.col("file_id"))
    got = index.floor(keys, entries, "at", else_first=else_first)
    lowest = -(-first // 7) * 7
    at = lambda i, f: i // 7 * 70 + f if i >= lowest else lowest * 10 + f if else_first else None
    assert {(r.file_id, r.key, r["at"]) for r in got.collect()} == {(f, f"k{i}", at(i, f)) for f in (1, 2) for i in range(n)}
    assert got.count() == 2 * n
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    begins = re.findall(r"rowframe, ([^,]*), unboundedfollowing", plan)
    assert "rowframe, unboundedpreceding" in plan and all(b.startswith("unboundedpreceding") for b in begins)


def test_log(spark, make):
    rows = make(*[(f"key-{i}", "v", "x", i, 0, 0) for i in range(6)]).withColumn("segment_id", (F.col("seq") / 3).cast("int")).withColumn("bad_crc", F.col("seq") == 4)
    assert [r.seq for r in log.replay_prefix(rows).orderBy("seq").collect()] == [0, 1, 2, 3]
    assert tuple(log.replay_stats(rows).first()) == (2, 4, 1)
    left = log.recycled(spark.createDataFrame([(0, False), (1, False), (2, True)], "segment_id int, active boolean"), 1)
    assert [r.segment_id for r in left.collect()] == [2]


def test_memory_size_counts_every_put(make):
    kib = make(*[("key-1", "data", "x" * 1024, i, 0, 0) for i in range(3)]).withColumn("generation", F.lit(0))
    assert metrics.memtable_size(kib).first().estimated_bytes == 3 * (5 + 16 + 8 + 1024 + 32)


def test_first_hit_hides_older_columns(spark, make):
    memory = make(("k", "new", "1", 5, 0, 0)).withColumn("tier", F.lit(0))
    disk = with_token(make(("k", "old", "2", 9, 0, 0), ("d", "old", "3", 9, 0, 0))).withColumns({"file_id": F.lit(7).cast("long"), "level": F.lit(0)})
    known = catalog.statistics(disk).withColumn("catalog_pos", F.lit(0))
    keys = with_token(spark.createDataFrame([("k",), ("d",), ("none",)], "key string"))
    assert {(r.key, r.name) for r in lookup.read_first_hit(keys, memory, disk, known).collect()} == {("k", "new"), ("d", "old")}
    assert {(r.key, r.name) for r in lookup.read_reconciled(keys, memory, disk).collect()} == {("k", "new"), ("k", "old"), ("d", "old")}
