"""The store, its log files and the stream, end to end."""

import threading

import pytest
from stratalog.functions.tokens import with_token
from stratalog.model import CELL, Settings
from stratalog.operators import catalog
from stratalog.operators.reconcile import memtable_merge
from stratalog.sources import log_files as lf
from stratalog.sources import tables
from stratalog.sources.storage import CellStore
from stratalog.streaming.ingest import ingest, merged_stream


def values(df):
    return {(r.key, r.name): r.value for r in df.collect()}


def test_a_life(spark, tmp_path):
    store = CellStore(spark, str(tmp_path))
    store.put("k", "a", "1", ts=100)
    store.put("k", "b", "2", ts=100)
    assert values(store.read(["k", "none"])) == {("k", "a"): "1", ("k", "b"): "2"}
    assert store.force_flush() and not store.force_flush()
    store.delete("k", "a", ts=200)
    assert values(store.read(["k"])) == {("k", "a"): None}  # the newer row hides the older
    assert values(store.read(["k"], reconciled=True)) == {("k", "a"): None, ("k", "b"): "2"}
    again = CellStore(spark, str(tmp_path))  # after a crash: log and manifest are enough
    assert values(again.read(["k"], reconciled=True)) == {("k", "a"): None, ("k", "b"): "2"}
    for i in range(3):
        store.put(f"x{i}", "a", "v", ts=300)
        store.force_flush()
    assert store.stats()["sstables"] == 4
    assert store.compact_once(now=10**15) and store.stats()["sstables"] == 1
    assert values(store.read(["k", "x0", "x1"], reconciled=True)) == {("k", "b"): "2", ("x0", "a"): "v", ("x1", "a"): "v"}  # no grace: the delete is purged
    assert [tuple(r)[:2] for r in store.level_summary().collect()] == [(0, 1)]
    store.close()
    with pytest.raises(RuntimeError):
        store.put("k", "a", "1")
    with pytest.raises(ValueError):
        again.put("", "a", "1")


def test_leveled_files_do_not_overlap(spark, tmp_path):
    store = CellStore(spark, str(tmp_path), Settings(strategy="LCS"))
    for batch in range(4):
        store.write(spark.createDataFrame([(f"key-{7 * i + batch}", "v", str(i), i, 0, 0, i) for i in range(30)], CELL))
        store.force_flush()
    assert store.compact_once(now=10**15)
    assert catalog.level_conflicts(store.catalog_snapshot()).count() == 0
    assert {r.level for r in store.level_summary().collect()} == {1}


def test_log_files(spark, tmp_path):
    good = lf.encode_record("replay-key", [("col1", "hello", 1000, 0, 0), ("col2", "wörld", 2000, 2, 9), ("col3", None, 5, 1, 0)])
    assert lf.decode_record(good) == ("replay-key", [("col1", "hello", 1000, 0, 0), ("col2", "wörld", 2000, 2, 9), ("col3", None, 5, 1, 0)])
    torn = bytearray(lf.frame(good))
    torn[-1] ^= 1
    (tmp_path / "segment-7.clog").write_bytes(lf.header(7) + lf.frame(good) + lf.frame(good) + bytes(torn) + lf.frame(good))
    (tmp_path / "odd.clog").write_bytes(lf.header(0) + lf.frame(good)[:-2])
    (tmp_path / "other.txt").write_bytes(b"x")
    out = lf.read_segments(spark, str(tmp_path)).collect()
    assert len(out) == 6 and {r.segment_id for r in out} == {7}
    assert {(r.name, r.value) for r in out} == {("col1", "hello"), ("col2", "wörld"), ("col3", None)}


def test_segments_are_written_and_truncated(spark, tmp_path):
    records = [lf.encode_record(f"key-{i}", [("v", "x", i, 0, 0)]) for i in range(5)]
    lf.write_segment(spark, str(tmp_path), 3, records)
    data = (tmp_path / "3.clog").read_bytes()
    assert [r.key for r in lf.read_segments(spark, str(tmp_path)).orderBy("offset").collect()] == [f"key-{i}" for i in range(5)]
    torn = data[:-3]
    assert lf.truncated(torn) == data[: len(data) - len(lf.frame(records[-1]))] and lf.truncated(data) == data
    assert lf.truncated(b"no header") == b""


def test_a_point_read_opens_only_files_whose_range_holds_the_key(spark, tmp_path):
    store, rows = CellStore(spark, str(tmp_path)), sorted(with_token(spark.createDataFrame([(f"key-{i}",) for i in range(60)], "key string")).collect(), key=lambda r: r.token)
    for k in range(0, 60, 20):  # three files of disjoint ranges
        store.write(spark.createDataFrame([(r.key, "v", "x", 1, 0, 0, i) for i, r in enumerate(rows[k : k + 20])], CELL))
        store.force_flush()
    asked, files = store.candidates([rows[30].key])
    assert [r.file_id for r in files.collect()] == [1]
    opened = store.read([rows[30].key]).inputFiles()
    assert {f.split("/data/")[1][:10] for f in opened if "/data/" in f} == {"0000000001"}
    assert values(store.read([rows[30].key, rows[50].key, "none"])) == {(rows[k].key, "v"): "x" for k in (30, 50)}
    assert {r.file_id for r in store.index().collect()} == {r.file_id for r in store.summary().collect()} == {0, 1, 2}


def test_overwrites_of_one_key_make_a_flush_due(spark, tmp_path):
    store = CellStore(spark, str(tmp_path), Settings(memtable_bytes=2_000))
    store.write(spark.createDataFrame([("hot", "v", "x" * 100, i, 0, 0, i) for i in range(5)], CELL))
    assert not store.flush_due()
    store.write(spark.createDataFrame([("hot", "v", "x" * 100, i, 0, 0, i) for i in range(20)], CELL))
    assert store.flush_due()


def test_readers_of_an_old_version_go_on_until_the_vacuum(spark, tmp_path):
    store = CellStore(spark, str(tmp_path))
    for i in range(4):
        store.put(f"k{i}", "a", str(i), ts=i + 1)
        store.force_flush()
    old = store.read(["k0", "k3"])
    assert store.compact_once(now=10**15)
    want = {("k0", "a"): "0", ("k3", "a"): "3"}
    assert values(old) == want and values(store.read(["k0", "k3"])) == want
    store.vacuum()
    assert values(store.read(["k0", "k3"])) == want
    assert store._names("data") == [4] and store._names("log") == [] and len(store._names("manifest")) == 1


def test_the_compaction_loop_outlives_a_failure(spark, tmp_path):
    store, stop, seen = CellStore(spark, str(tmp_path)), threading.Event(), []

    def failing(now):
        seen.append(now)
        if len(seen) == 3:
            stop.set()
        raise OSError("no disk")

    store.compact_once = failing
    store.keep_compacting(stop, every=0.01)
    assert len(seen) == 3


@pytest.fixture
def parts(spark, sf, tmp_path):
    cells = tables.mutations(spark, sf).select(*[c.split()[0] for c in CELL.split(", ")], "segment_id")
    cells.repartition("segment_id").write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), cells


def test_stream_equals_batch(spark, parts):
    path, cells = parts
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(path)
    merged_stream(stream).writeStream.outputMode("complete").format("memory").queryName("merged").trigger(availableNow=True).start().awaitTermination()
    want = memtable_merge(cells)
    got = spark.table("merged")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_ingest_into_the_store(spark, parts, tmp_path):
    path, cells = parts
    store = CellStore(spark, str(tmp_path / "store"), Settings(memtable_bytes=2_000))
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 2).parquet(path)
    ingest(stream, store, str(tmp_path / "mark")).awaitTermination()
    keys = cells.select("key").distinct()
    got = store.read(keys, reconciled=True).select("key", "name", "value", "ts")
    want = memtable_merge(cells).select("key", "name", "value", "ts")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert store.counts["flushes"] > 0


def test_settings(monkeypatch):
    monkeypatch.setenv("COMPACTION_STRATEGY", "lcs")
    assert Settings().strategy == "LCS"
    with pytest.raises(ValueError):
        Settings(strategy="none")
