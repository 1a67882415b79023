"""Every operator applied to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cells as c
from .functions import text
from .functions.tokens import bloom_size_columns, with_crc32c, with_token
from .operators import bloom, catalog, index, log, lookup, metrics, reconcile
from .operators import cells as wide
from .plans import compaction as plan
from .sources import tables as t

#: The moment at which queries judge expiry: 2024-01-15 00:00 UTC and its grace period.
NOW, GRACE = 1_705_276_800_000_000, 86_400
#: How many times larger files are where levels must be over their targets.
OVER = 1_000
#: The range that token_range_scan reads.
LOW_TOKEN, HIGH_TOKEN = -(1 << 61), 1 << 62

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


class View:
    """The tables that most queries start from. The read workload asks for every key, and
    for some that were never written."""

    def __init__(self, spark: SparkSession, sf_dir: str, tied: bool = False):
        self.cells = t.mutations(spark, sf_dir, tied)
        self.memory = t.memory(self.cells)
        self.files = t.file_cells(self.cells)
        self.catalog = t.catalog(self.files)
        asked = self.cells.select("key").distinct()
        absent = spark.range(20).select(F.concat(F.lit("nobody:"), F.col("id").cast("string")).alias("key"))
        self.asked = with_token(asked.unionByName(absent))


@query
def memtable_merge(spark, sf):
    return reconcile.memtable_merge(t.mutations(spark, sf))


@query
def memtable_merge_ties(spark, sf):
    return reconcile.memtable_merge(t.mutations(spark, sf, tied=True))


@query
def lineitem_merge(spark, sf):
    return reconcile.memtable_merge(t.lineitem_cells(spark, sf)).select("key", "name", "value", "ts")


@query
def memtable_scan(spark, sf):
    return with_token(t.memory(t.mutations(spark, sf)).where("tier = 0")).select("token", "key", "name", "value", "ts").orderBy("token", "key", "name")


@query
def memtable_get(spark, sf):
    return t.memory(t.mutations(spark, sf)).where("tier = 0 and key = 'user:000007'").select("key", "name", "value", "ts", "flags")


@query
def token_range_scan(spark, sf):
    cells = with_token(reconcile.memtable_merge(t.mutations(spark, sf)))
    return lookup.token_range(cells, LOW_TOKEN, HIGH_TOKEN).select("token", "key", "name", "value", "ts").orderBy("token", "key", "name")


@query
def token_order(spark, sf):
    return lookup.token_places(t.keys(t.mutations(spark, sf))).select("key", "token", "place")


@query
def key_token(spark, sf):
    return t.keys(t.mutations(spark, sf)).select("key", "token")


@query
def log_replay_prefix(spark, sf):
    return log.replay_prefix(t.mutations(spark, sf)).select("segment_id", "seq", "key", "name", "ts")


@query
def log_replay_stats(spark, sf):
    return log.replay_stats(t.mutations(spark, sf))


@query
def log_offsets(spark, sf):
    return log.offsets(t.mutations(spark, sf)).select("segment_id", "seq", "frame", "offset")


@query
def segment_roll(spark, sf):
    rolled = log.rolled(t.mutations(spark, sf).withColumn("writer", F.col("segment_id")), limit=8192)
    return rolled.select("writer", "seq", "segment")


@query
def last_good_position(spark, sf):
    return log.last_good(t.mutations(spark, sf))


@query
def segment_recycle(spark, sf):
    segments = t.mutations(spark, sf).select("segment_id").distinct().withColumn("active", F.col("segment_id") == t.SEGMENTS - 1)
    return log.recycled(segments, flushed=5)


@query
def max_log_position(spark, sf):
    ends = log.offsets(t.mutations(spark, sf)).select("segment_id", F.col("offset").alias("position"))
    return catalog.max_log_position(ends)


@query
def min_log_position(spark, sf):
    ends = log.offsets(t.mutations(spark, sf)).select("segment_id", F.col("offset").alias("position"))
    return catalog.min_log_position(ends)


@query
def log_metrics(spark, sf):
    m = t.mutations(spark, sf)
    return metrics.log_metrics(log.rolled(m.withColumn("writer", F.col("segment_id")), limit=8192), m)


@query
def encoded_size(spark, sf):
    merged = reconcile.memtable_merge(t.mutations(spark, sf))
    return merged.groupBy("key").agg(c.record_bytes().alias("bytes"))


@query
def cells_from_wide(spark, sf):
    customer = t.table(spark, sf, "customer")
    key = F.concat(F.lit("customer:"), F.col("c_custkey").cast("string"))
    return wide.cells_from_wide(customer, key, ["c_name", "c_mktsegment", "c_nationkey"], F.lit(0).cast("long"), F.col("c_custkey")).select("key", "name", "value", "flags")


@query
def tombstone_cells(spark, sf):
    gone = t.mutations(spark, sf).where("seq % 10 = 9").select("key", "name").distinct()
    return wide.tombstones(gone, F.lit(NOW), F.lit(0).cast("long")).select("key", "name", "value", "ts", "flags")


@query
def row_assembly(spark, sf):
    rows = wide.assembled(reconcile.memtable_merge(t.mutations(spark, sf)))
    return rows.select("key", F.size("cells").cast("long").alias("n"), F.array_join(F.transform("cells", lambda x: x["name"]), ",").alias("names"))


@query
def row_json(spark, sf):
    return wide.row_json(reconcile.memtable_merge(t.mutations(spark, sf)))


@query
def is_tombstone(spark, sf):
    return t.mutations(spark, sf).where(c.is_tombstone()).select("seq", "key", "name")


@query
def ttl_expired(spark, sf):
    return t.mutations(spark, sf).where(c.is_expired(NOW)).select("seq", "key", "name", "ts", "ttl")


@query
def live_view(spark, sf):
    return reconcile.memtable_merge(t.mutations(spark, sf)).where(c.is_live(NOW)).select("key", "name", "value", "ts")


@query
def purgeable_tombstones(spark, sf):
    return t.mutations(spark, sf).where(c.is_purgeable(NOW, GRACE)).select("seq", "key", "name", "ts")


@query
def cell_render(spark, sf):
    return t.mutations(spark, sf).select("seq", c.rendered().alias("shown"))


@query
def tombstone_purge(spark, sf):
    return reconcile.purge(reconcile.memtable_merge(t.mutations(spark, sf)), NOW, GRACE).select("key", "name", "value", "ts")


@query
def tombstone_purge_safe(spark, sf):
    v = View(spark, sf)
    inputs = v.files.where("level = 0")
    merged = reconcile.memtable_merge(inputs, ("token", "key", "name"))
    return reconcile.purge_safe(merged, v.catalog.where("level = 1"), NOW, 0).select("key", "name", "ts", "flags")


@query
def purged_rows(spark, sf):
    return reconcile.purged(reconcile.memtable_merge(t.mutations(spark, sf)), NOW, 0)


@query
def sstable_full_scan(spark, sf):
    return t.file_cells(t.mutations(spark, sf)).select("file_id", "token", "key", "name", "value", "ts", "flags").orderBy("file_id", "token", "key", "name")


@query
def sstable_statistics(spark, sf):
    return catalog.statistics(t.file_cells(t.mutations(spark, sf)))


@query
def catalog_rebuild(spark, sf):
    found = t.file_cells(t.mutations(spark, sf)).select("file_id", "level").distinct()
    listed = found.withColumn("level", F.when(F.col("level") > 0, F.col("level"))).unionByName(spark.createDataFrame([(900, 1)], "file_id long, level int"))
    return catalog.rebuilt(listed, found)


@query
def file_age(spark, sf):
    return catalog.with_age(View(spark, sf).catalog, NOW // 1000).select("file_id", "age_seconds")


@query
def level_summary(spark, sf):
    return catalog.level_summary(View(spark, sf).catalog)


@query
def range_prune(spark, sf):
    v = View(spark, sf)
    return catalog.candidates(v.asked, v.catalog).select("key", "file_id")


@query
def sstable_overlaps(spark, sf):
    return catalog.overlaps(View(spark, sf).catalog)


@query
def level_overlap_check(spark, sf):
    return catalog.level_conflicts(View(spark, sf).catalog)


@query
def sparse_index(spark, sf):
    return index.sparse_index(catalog.partitions(t.file_cells(t.mutations(spark, sf))), 512)


@query
def summary_index(spark, sf):
    return index.summary(index.sparse_index(catalog.partitions(t.file_cells(t.mutations(spark, sf))), 256), 4)


@query
def index_floor(spark, sf):
    v = View(spark, sf)
    found = index.floor(catalog.candidates(v.asked, v.catalog), index.sparse_index(catalog.partitions(v.files), 512), "data_offset")
    return found.withColumn("data_offset", F.coalesce("data_offset", F.lit(-1)))  # -1: before every entry


@query
def summary_floor(spark, sf):
    v = View(spark, sf)
    entries = index.summary(index.sparse_index(catalog.partitions(v.files), 256), 4)
    return index.floor(catalog.candidates(v.asked, v.catalog), entries, "index_offset", else_first=True)


@query
def bloom_sizing(spark, sf):
    bits, hashes = bloom_size_columns(F.col("n"))
    return t.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).select("o_orderpriority", "n", bits.alias("bits"), hashes.alias("hashes"))


def _file_keys(v: View) -> DataFrame:
    return v.files.select("file_id", "token", "key").distinct()


@query
def bloom_build(spark, sf):
    return bloom.build(_file_keys(View(spark, sf)))


@query
def bloom_probe(spark, sf):
    v = View(spark, sf)
    asked = catalog.candidates(v.asked, v.catalog.where("level = 0"))
    return bloom.probe(asked.select("file_id", "token", "key"), _file_keys(v))


@query
def bloom_fpp(spark, sf):
    rate = bloom.false_positive_rate(bloom.sizes(_file_keys(View(spark, sf))))
    return rate.select("file_id", "keys", "bits", "hashes", F.round("fpp", 9).alias("fpp"))


@query
def filter_memory(spark, sf):
    return bloom.memory_bytes(bloom.sizes(_file_keys(View(spark, sf)))).select("file_id", "bits", "memory_bytes")


@query
def read_first_hit(spark, sf):
    v = View(spark, sf)
    return lookup.read_first_hit(v.asked, v.memory, v.files, v.catalog)


@query
def read_reconciled(spark, sf):
    v = View(spark, sf)
    return lookup.read_reconciled(v.asked, v.memory, v.files)


@query
def multi_get(spark, sf):
    v = View(spark, sf)
    return lookup.multi_get(v.asked, reconcile.memtable_merge(v.cells)).select("key", "name", "value", "ts")


@query
def sstable_lookup_trace(spark, sf):
    v = View(spark, sf)
    return lookup.trace(v.asked, v.memory, v.files, v.catalog).select("key", "file_id", "place", "might_contain", "holds")


@query
def lookup_counters(spark, sf):
    v = View(spark, sf)
    return lookup.lookup_counters(lookup.trace(v.asked, v.memory, v.files, v.catalog))


def _amplification(v: View) -> DataFrame:
    return lookup.read_amplification(v.asked, v.memory, v.files, v.catalog)


@query
def read_amplification(spark, sf):
    return _amplification(View(spark, sf)).withColumn("scans_per_read", F.round("scans_per_read", 9))


@query
def tier_share(spark, sf):
    return metrics.tier_share(_amplification(View(spark, sf)))


@query
def memtable_size(spark, sf):
    return metrics.memtable_size(t.mutations(spark, sf))


@query
def flush_due(spark, sf):
    return metrics.flush_due(t.mutations(spark, sf), 32_768)


@query
def engine_stats(spark, sf):
    v = View(spark, sf)
    return metrics.engine_stats(v.cells, v.catalog, _amplification(v)).withColumn("hit_ratio", F.round("hit_ratio", 9))


@query
def stats_rate(spark, sf):
    polls = t.mutations(spark, sf).groupBy(F.floor(F.col("seq") / 500).alias("poll")).agg(F.max("seq").alias("total"), F.floor(F.max("ts") / 1000).alias("at_ms"))
    return metrics.stats_rate(polls.withColumn("counter", F.lit("writes"))).select("counter", "at_ms", "total", F.round("rate", 9).alias("rate"))


def _generations(spark, sf) -> tuple[DataFrame, DataFrame]:
    """One file per slice, all of level 0."""
    files = reconcile.memtable_merge(with_token(t.mutations(spark, sf, tied=True)).withColumn("file_id", F.col("generation").cast("long")).withColumn("level", F.lit(0)), ("file_id", "level", "token", "key", "name"))
    return files, t.catalog(files)


@query
def stcs_buckets(spark, sf):
    return plan.stcs_buckets(View(spark, sf).catalog)


@query
def stcs_select(spark, sf):
    return plan.stcs_select(plan.stcs_buckets(_generations(spark, sf)[1]))


@query
def stcs_plan(spark, sf):
    return plan.SizeTiered().plan(_generations(spark, sf)[1])


@query
def compaction_merge(spark, sf):
    files, _ = _generations(spark, sf)
    return reconcile.compaction_merge(files.withColumn("input_pos", F.col("file_id") * 7 % 16))


@query
def stcs_compact(spark, sf):
    files, cat = _generations(spark, sf)
    return plan.execute(plan.SizeTiered().plan(cat), files, NOW, GRACE)


@query
def lcs_level_scores(spark, sf):
    return plan.level_scores(View(spark, sf).catalog).withColumn("score", F.round("score", 9))


@query
def lcs_overlap_closure(spark, sf):
    cat = View(spark, sf).catalog
    return plan.overlap_closure(cat.where("file_id = 100"), cat.where("file_id <> 100 and level > 0"))


@query
def lcs_plan(spark, sf):
    return plan.Leveled().plan(View(spark, sf).catalog)


@query
def lcs_plan_over_target(spark, sf):
    """Level 0 is not full, and levels 1 and 2 hold more than their targets."""
    cat = View(spark, sf).catalog.where("level > 0 or file_id >= 12")
    return plan.Leveled().plan(cat.withColumn("data_size_bytes", F.col("data_size_bytes") * OVER))


@query
def lcs_compact(spark, sf):
    v = View(spark, sf)
    return plan.execute(plan.Leveled().plan(v.catalog), v.files, NOW, GRACE)


def _cycle(files: DataFrame, cat: DataFrame, strategy: str, new_id: int) -> tuple[DataFrame, DataFrame]:
    """The plan and the cells of all files after one compaction."""
    chosen = plan.strategy(strategy).plan(cat)
    out = plan.execute(chosen, files, NOW, GRACE).withColumn("file_id", F.lit(new_id).cast("long"))
    return chosen, files.join(chosen.select("file_id"), "file_id", "left_anti").unionByName(out.select(*files.columns))


@query
def compaction_cycle(spark, sf):
    files, cat = _generations(spark, sf)
    return catalog.statistics(_cycle(files, cat, "STCS", 1000)[1]).select("file_id", "level", "partition_count", "cell_count", "data_size_bytes")


def _amplified(files: DataFrame, cat: DataFrame, strategy: str) -> DataFrame:
    chosen, after = _cycle(files, cat, strategy, 1000)
    return metrics.write_amplification(cat, chosen, cat, catalog.statistics(after.where("file_id = 1000")))


@query
def write_amplification(spark, sf):
    out = _amplified(*_generations(spark, sf), "STCS")
    return out.withColumn("amplification", F.round("amplification", 9))


@query
def strategy_comparison(spark, sf):
    files, cat = _generations(spark, sf)
    both = metrics.comparison(_amplified(files, cat, "STCS"), _amplified(files, cat, "LCS"))
    return both.select("metric", F.round("STCS", 9).alias("stcs"), F.round("LCS", 9).alias("lcs"))


@query
def crc32c(spark, sf):
    names = t.table(spark, sf, "part").select("p_partkey", F.col("p_name").cast("binary").alias("data"))
    return with_crc32c(names, "data").select("p_partkey", "crc")


@query
def key_token_long(spark, sf):
    """Keys of 16 to 31 bytes: a block and a tail."""
    return with_token(t.table(spark, sf, "customer").select(F.col("c_name").alias("key")).where("octet_length(key) between 16 and 31").distinct()).select("key", "token")


@query
def abbreviations(spark, sf):
    n = F.floor(F.col("o_totalprice") * F.col("o_orderkey") / 100).cast("long")
    return t.table(spark, sf, "orders").select("o_orderkey", n.alias("n"), text.abbreviated(n).alias("short"), text.abbreviated_bytes(n).alias("size"))


@query
def query_decode(spark, sf):
    """Requests as the service gets them, with encoded names and values."""
    query = F.concat(F.lit("key="), F.url_encode("c_name"), F.lit("&x%20y=a+b%26c&none&key2="), F.url_encode("c_mktsegment"), F.lit("&key2=%C3%A9"))
    asked = t.table(spark, sf, "customer").select("c_custkey", text.query_parameters(query).alias("q"))
    return asked.select("c_custkey", F.col("q")["key"].alias("key"), F.col("q")["x y"].alias("x_y"), F.col("q")["key2"].alias("key2"), F.size("q").cast("long").alias("names"))


@query
def blast_rows(spark, sf):
    return wide.blast(spark, 2000)
