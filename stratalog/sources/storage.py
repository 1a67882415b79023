"""A store of cells on any Hadoop file system.

Writes go to log segments; a flush turns the segments since the last one into a file of
level 0; compaction replaces files. Cells lie in Parquet, sorted by token, with Bloom
filters on the key; each has its sparse index and summary beside it. A manifest lists the
live files and how far the log is flushed; a new version is a whole table, and counts once
its _SUCCESS mark is there, so readers and a restart after a crash see the state before or
after a step and nothing between. Replay reads segments past the flushed one, each once.
Files and segments that a step replaces stay until vacuum(), for readers of old versions.

A write returns when its segment is finished, which is what BATCH asks for; PERIODIC, which
would allow to lose the last moments, is accepted and gets the same.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Iterable
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import with_token
from ..model import CELL, TOMBSTONE, Settings
from ..operators import catalog as cat
from ..operators import index, lookup, metrics
from ..operators.reconcile import memtable_merge
from ..plans import compaction

CATALOG = (
    "file_id long, level int, partition_count long, cell_count long, min_token long, min_key string, max_token long,"
    " max_key string, data_size_bytes long, created_at_ms long, catalog_pos int"
)
#: Keys of a read that are named in the scan's filter.
LISTED_KEYS = 1_000
FILE = "key string, name string, value string, ts long, flags int, ttl int, seq long, token long"


class CellStore:
    """write, delete, read, force_flush, compact_once, keep_compacting, vacuum, stats,
    level_summary, catalog_snapshot and close."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings or Settings()
        self.counts = {"writes": 0, "flushes": 0, "compactions": 0, "reads": 0}
        self._closed = False

    # The file system

    def _names(self, kind: str) -> list[int]:
        """Numbers of the finished tables below root/kind, ascending."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = (s.getPath() for s in fs.listStatus(path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
        return sorted(int(p.getName()) for p in done)

    def _drop(self, kind: str, number: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}/{number:010d}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _table(self, kind: str, number: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{kind}/{number:010d}")

    def _tables(self, kind: str, numbers: Iterable[int], schema: str, name: str) -> DataFrame:
        """Several tables of a kind in one scan, with the number of each row's as `name`."""
        paths = [f"{self.root}/{kind}/{n:010d}" for n in numbers]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, {name} long")
        number = F.regexp_extract("_metadata.file_path", f"/{kind}/([0-9]+)/[^/]*$", 1).cast("long")
        return self.spark.read.schema(schema).parquet(*paths).select("*", number.alias(name))

    def _write_file(self, cells: DataFrame, number: int, keys: int) -> None:
        ordered = cells.select(*[c.split()[0] for c in FILE.split(", ")]).repartitionByRange("token").sortWithinPartitions("token", "key", "name")
        writer = ordered.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(max(1, keys)))
        writer.option("parquet.bloom.filter.fpp#key", "0.01").mode("overwrite").parquet(f"{self.root}/data/{number:010d}")

    # Manifest

    def _manifest(self) -> tuple[int, int, DataFrame]:
        """(version, last flushed segment, catalog)."""
        versions = self._names("manifest")
        if not versions:
            return -1, -1, self.spark.createDataFrame([], CATALOG)
        table = self._table("manifest", versions[-1], CATALOG + ", flushed long")
        flushed = table.where("file_id is null").first()["flushed"]
        return versions[-1], flushed, table.where("file_id is not null").drop("flushed")

    def _publish(self, version: int, flushed: int, files: DataFrame) -> None:
        rows = files.select(*[c.split()[0] for c in CATALOG.split(", ")]).withColumn("flushed", F.lit(None).cast("long"))
        mark = self.spark.createDataFrame([(None,) * 11 + (flushed,)], CATALOG + ", flushed long")
        rows.unionByName(mark).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/{version:010d}")

    def catalog_snapshot(self) -> DataFrame:
        return self._manifest()[2]

    # Writes

    def write(self, cells: DataFrame) -> int:
        """Append cells (key, name, value, ts, flags, ttl, seq) as one log segment; its number."""
        if self._closed:
            raise RuntimeError("the store is closed")
        short = cells.select(*[c.split()[0] for c in CELL.split(", ")])
        if short.where("key is null or octet_length(key) not between 1 and 65535").take(1):
            raise ValueError("a key needs 1 to 65535 bytes")
        segments = self._names("log")
        number = max(segments[-1] if segments else -1, self._manifest()[1]) + 1
        short.write.mode("overwrite").parquet(f"{self.root}/log/{number:010d}")
        self.counts["writes"] += 1
        return number

    def _one(self, key: str, name: str, value: str | None, ts: int | None, flags: int) -> int:
        ts = time.time_ns() // 1_000_000 * 1000 if ts is None else ts
        return self.write(self.spark.createDataFrame([(key, name, value, ts, flags, 0, self.counts["writes"])], CELL))

    def put(self, key: str, name: str, value: str, ts: int | None = None) -> int:
        return self._one(key, name, value, ts, 0)

    def delete(self, key: str, name: str, ts: int | None = None) -> int:
        return self._one(key, name, None, ts, TOMBSTONE)

    # Reads

    def memory(self) -> DataFrame:
        """Segments not yet flushed, merged; later segments count as later arrivals."""
        flushed = self._manifest()[1]
        waiting = [n for n in self._names("log") if n > flushed]
        cells = self._tables("log", waiting, CELL, "segment")
        best = cells.groupBy("key", "name").agg(F.max_by(F.struct("value", "ts", "flags", "ttl", "seq"), F.struct("ts", "segment", "seq")).alias("c"))
        return best.select("key", "name", "c.*").withColumn("tier", F.lit(lookup.MEM))

    def file_cells(self, files: DataFrame | None = None) -> DataFrame:
        """The cells of the files (file_id, level) of a catalog, or of all live ones."""
        known = (self.catalog_snapshot() if files is None else files).select("file_id", "level").collect()  # a row per file
        levels = self.spark.createDataFrame([(f["file_id"], f["level"]) for f in known], "file_id long, level int")
        return self._tables("data", [f["file_id"] for f in known], FILE, "file_id").join(levels, "file_id").select(*[c.split()[0] for c in FILE.split(", ")], "file_id", "level")

    def candidates(self, keys: DataFrame | list[str]) -> tuple[DataFrame, DataFrame]:
        """(keys with their tokens, catalog rows of the files whose range holds one)."""
        if isinstance(keys, list):
            keys = self.spark.createDataFrame([(k,) for k in keys], "key string")
        asked, files = with_token(keys.select("key").distinct()), self.catalog_snapshot()
        near = cat.candidates(asked, files).select("file_id").distinct()
        return asked, files.join(near, "file_id", "left_semi")

    def read(self, keys: DataFrame | list[str], reconciled: bool = False) -> DataFrame:
        """Cells of the keys: of the first tier that has a key, or the winners of all. Only
        files whose range holds a key are opened; a list of keys goes along to the scan,
        whose row groups are passed over by their bounds and filters."""
        self.counts["reads"] += 1
        asked, files = self.candidates(keys)
        cells = self.file_cells(files)
        if isinstance(keys, list) and len(keys) <= LISTED_KEYS:
            cells = cells.where(F.col("key").isin(keys))
        if reconciled:
            return lookup.read_reconciled(asked, self.memory(), cells)
        return lookup.read_first_hit(asked, self.memory(), cells, files)

    def index(self) -> DataFrame:
        """The stored sparse index of every live file."""
        return self._tables("index", self._live(), "token long, key string, data_offset long, entry long", "file_id")

    def summary(self) -> DataFrame:
        """The stored summary of every live file: each 128th entry of its index."""
        return self._tables("summary", self._live(), "token long, key string, index_offset long", "file_id")

    def _live(self) -> list[int]:
        return [r["file_id"] for r in self.catalog_snapshot().select("file_id").collect()]

    # Background steps, run when called

    def flush_due(self) -> bool:
        """Every waiting put counts in full, overwritten ones too."""
        flushed = self._manifest()[1]
        waiting = self._tables("log", [n for n in self._names("log") if n > flushed], CELL, "segment")
        size = metrics.memtable_size(waiting.withColumn("one", F.lit(1)), by="one").first()
        return bool(size) and size["estimated_bytes"] >= self.settings.memtable_bytes

    def _described(self, number: int, level: int) -> DataFrame:
        """Statistics of a new file, whose index and summary are written beside it."""
        cells = self._table("data", number, FILE).withColumns({"file_id": F.lit(number).cast("long"), "level": F.lit(level)})
        entries = index.sparse_index(cat.partitions(cells))
        entries.drop("file_id").write.mode("overwrite").parquet(f"{self.root}/index/{number:010d}")
        stored = self._tables("index", [number], "token long, key string, data_offset long, entry long", "file_id")
        index.summary(stored).drop("file_id").write.mode("overwrite").parquet(f"{self.root}/summary/{number:010d}")
        return cat.statistics(cells)

    def force_flush(self) -> bool:
        """Turn waiting segments into a file of level 0; false if there are none."""
        version, flushed, files = self._manifest()
        waiting = [n for n in self._names("log") if n > flushed]
        merged = with_token(self.memory().drop("tier"))
        if not waiting or not merged.take(1):
            return False
        number = self._next_file()
        self._write_file(merged, number, merged.select("key").distinct().count())
        new = self._described(number, 0).withColumn("created_at_ms", F.lit(time.time_ns() // 1_000_000)).withColumn("catalog_pos", F.lit(0))
        self._publish(version + 1, waiting[-1], new.unionByName(files.withColumn("catalog_pos", F.col("catalog_pos") + 1)))
        self.counts["flushes"] += 1
        return True

    def _next_file(self) -> int:
        numbers = self._names("data")
        return numbers[-1] + 1 if numbers else 0

    def compact_once(self, now: int) -> bool:
        """Plan and run one compaction; only the files that were merged are replaced."""
        version, flushed, files = self._manifest()
        plan = compaction.strategy(self.settings.strategy).plan(files)
        inputs = plan.collect()  # a row per input file
        if not inputs:
            return False
        known = self.spark.createDataFrame(inputs, plan.schema)
        merged = compaction.execute(known, self.file_cells(files.join(known.select("file_id"), "file_id", "left_semi")), now, self.settings.grace_seconds)
        number, level = self._next_file(), inputs[0]["output_level"]
        self._write_file(merged, number, merged.select("key").distinct().count())
        rest = files.join(known.select("file_id"), "file_id", "left_anti").withColumn("catalog_pos", F.col("catalog_pos") + 1)
        new = self._described(number, level).withColumn("created_at_ms", F.lit(now // 1000)).withColumn("catalog_pos", F.lit(0))
        self._publish(version + 1, flushed, new.unionByName(rest))
        self.counts["compactions"] += 1
        return True

    def keep_compacting(self, stop: Event, every: float = 2.0) -> None:
        """Compact whenever there is something to do, until stop is set. A step that fails
        is logged and tried again; run this in a thread of its own."""
        while not stop.wait(every):
            try:
                self.compact_once(time.time_ns() // 1000)
            except Exception:
                logging.getLogger(__name__).exception("a compaction failed")

    def vacuum(self, versions: int = 1) -> None:
        """Delete what none of the last so many versions of the manifest names: their
        readers go on, those of older ones do not."""
        known = self._names("manifest")
        kept = known[-max(1, versions) :]
        if not kept:
            return
        table = self._tables("manifest", kept, CATALOG + ", flushed long", "version").select("file_id", "flushed").distinct().collect()
        live = {r["file_id"] for r in table if r["file_id"] is not None}
        flushed = min(r["flushed"] for r in table if r["file_id"] is None)
        for kind, gone in (("data", lambda n: n not in live), ("index", lambda n: n not in live), ("summary", lambda n: n not in live), ("log", lambda n: n <= flushed), ("manifest", lambda n: n < kept[0])):
            for n in filter(gone, self._names(kind)):
                self._drop(kind, n)

    def level_summary(self) -> DataFrame:
        return cat.level_summary(self.catalog_snapshot())

    def stats(self) -> dict:
        files = self.catalog_snapshot().agg(F.count("*").alias("sstables"), F.coalesce(F.sum("data_size_bytes"), F.lit(0)).alias("bytes")).first()
        return self.counts | {"sstables": files["sstables"], "sstable_bytes": files["bytes"], "log_segments": len([n for n in self._names("log") if n > self._manifest()[1]])}

    def close(self) -> None:
        """Nothing is lost: what is not flushed is in the log."""
        self._closed = True
