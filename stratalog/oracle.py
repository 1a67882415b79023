"""The queries in DuckDB's SQL, written from the semantics rather than from the plans."""

from __future__ import annotations

from .functions.tokens import ADD_1, ADD_2, C1, C2, MIX_1, MIX_2, SEED_1, SEED_2
from .queries import GRACE, HIGH_TOKEN, LOW_TOKEN, NOW, OVER

_M = "18446744073709551615::UHUGEINT"
_W = "18446744073709551616::UHUGEINT"


def _u(x: int) -> str:
    return f"{x}::UHUGEINT"


def _rot(x: str, r: int) -> str:
    return f"((({x} << {_u(r)}) & {_M}) | ({x} >> {_u(64 - r)}))"


def _mul(a: str, b: int) -> str:
    return f"(({a} * {_u(b)}) % {_W})"


def _add(*xs: str) -> str:
    return f"(({' + '.join(xs)}) % {_W})"


def _tokens(source: str, block: bool = False) -> str:
    """CTEs that end in tokens(key, token, h) for keys of up to 15 bytes, or with a block
    before them; h is unsigned."""
    pairs = lambda at: " || ".join(f"substr(x, {at + 2 * i}, 2)" for i in range(7, -1, -1))
    first = f"SELECT key, hex(encode(key)) AS x, CAST(octet_length(encode(key)) AS UHUGEINT) AS n, {_u(SEED_1)} AS p, {_u(SEED_2)} AS q FROM (SELECT DISTINCT key FROM {source})"
    s = f"\nb0 AS ({first}),"
    if block:
        spin = lambda at, one, turn, two: _mul(_rot(_mul(f"CAST('0x' || {pairs(at)} AS UHUGEINT)", one), turn), two)
        s += f"\nb1 AS (SELECT key, x, n, xor(p, {spin(1, C1, 31, C2)}) AS p, xor(q, {spin(17, C2, 33, C1)}) AS q FROM b0),"
        s += f"\nb2 AS (SELECT key, x, n, {_add(_mul(_add(_rot('p', 27), _u(SEED_2)), 5), _u(ADD_1))} AS p, q FROM b1),"
        s += f"\nb0x AS (SELECT key, substr(x, 33) AS x, n, p, {_add(_mul(_add(_rot('q', 31), 'p'), 5), _u(ADD_2))} AS q FROM b2),"
    s += f"""
t0 AS (SELECT key, rpad(x, 32, '0') AS x, n, p, q FROM {"b0x" if block else "b0"}),
t1 AS (SELECT key, n, p, q, CAST('0x' || {pairs(1)} AS UHUGEINT) AS a, CAST('0x' || {pairs(17)} AS UHUGEINT) AS b FROM t0),
t2 AS (SELECT key, n, p, q, {_mul('a', C1)} AS a, {_mul('b', C2)} AS b FROM t1),
t3 AS (SELECT key, n, p, q, {_rot('a', 31)} AS a, {_rot('b', 33)} AS b FROM t2),
t4 AS (SELECT key, xor(xor(p, {_mul('a', C2)}), n) AS a, xor(xor(q, {_mul('b', C1)}), n) AS b FROM t3),
t5 AS (SELECT key, {_add('a', 'b')} AS a, {_add('a', 'b', 'b')} AS b FROM t4),"""
    k = 5
    for factor in (MIX_1, MIX_2, None):
        k += 1
        s += f"\nt{k} AS (SELECT key, xor(a, a >> {_u(33)}) AS a, xor(b, b >> {_u(33)}) AS b FROM t{k - 1}),"
        if factor:
            k += 1
            s += f"\nt{k} AS (SELECT key, {_mul('a', factor)} AS a, {_mul('b', factor)} AS b FROM t{k - 1}),"
    s += f"\nth AS (SELECT key, {_add('a', 'b')} AS h FROM t{k}),"
    return s + f"\ntokens AS (SELECT key, h, CAST(CASE WHEN h >= {_u(1 << 63)} THEN CAST(h AS HUGEINT) - 18446744073709551616::HUGEINT ELSE CAST(h AS HUGEINT) END AS BIGINT) AS token FROM th)"


def _mutations(tied: bool = False) -> str:
    ts = "epoch_us(date_trunc('day', ts)::TIMESTAMP)" if tied else "epoch_us(ts)"
    return f"""
mutations AS (
  SELECT 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, event_type AS name,
         CASE WHEN event_id % 10 = 9 THEN NULL ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS value, {ts} AS ts,
         CASE WHEN event_id % 10 = 9 THEN 1 WHEN event_id % 7 = 0 THEN 2 ELSE 0 END AS flags,
         CASE WHEN event_id % 10 <> 9 AND event_id % 7 = 0 THEN 432000 ELSE 0 END AS ttl, event_id AS seq,
         event_id * 8 // (SELECT count(*) FROM events) AS segment_id, event_id * 16 // (SELECT count(*) FROM events) AS generation, event_id % 997 = 996 AS bad_crc
  FROM events)"""


def _latest(source: str, by: str, order: str = "ts DESC, seq DESC") -> str:
    return f"(SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS _r FROM {source}) WHERE _r = 1)"


_MERGED = f"merged AS {_latest('mutations', 'key, name')}"
_FRAME = "coalesce(octet_length(encode(value)), 0) + octet_length(encode(name)) + 19"
_EXPIRED = f"(flags & 2 <> 0 AND {NOW} > ts + ttl::BIGINT * 1000000)"


def _purgeable(grace: int) -> str:
    return f"(flags & 1 <> 0 AND {NOW} > ts + {grace * 1_000_000})"


def _view(tied: bool = False, files: str = "sliced") -> str:
    """mutations, tokens, memory, files (cells of every file), parts (a row per file and
    key), catalog and asked."""
    placed = """
placed AS (SELECT m.*, k.token, CASE WHEN generation >= 10 THEN 0 WHEN generation >= 5 THEN 1 ELSE 2 END AS level,
                  CASE WHEN generation >= 10 THEN generation ELSE (CASE WHEN generation >= 5 THEN 100 ELSE 200 END) + floor(k.token / 4611686018427387904.0)::BIGINT + 2 END AS file_id
           FROM mutations m JOIN tokens k USING (key) WHERE generation < 15)"""
    if files == "generations":
        placed = "\nplaced AS (SELECT m.*, k.token, 0 AS level, generation AS file_id FROM mutations m JOIN tokens k USING (key))"
    return f"""{_mutations(tied)},
wanted AS (SELECT DISTINCT key FROM mutations UNION ALL SELECT 'nobody:' || i FROM range(20) r(i)),
every_key AS (SELECT key FROM mutations UNION SELECT key FROM wanted),{_tokens('every_key')},
asked AS (SELECT key, token FROM wanted JOIN tokens USING (key)),
memory AS {_latest("(SELECT *, CASE WHEN generation = 15 THEN 0 ELSE 1 END AS tier FROM mutations WHERE generation >= 14)", "tier, key, name")},{placed.replace("generation < 15", "generation < 14")},
files AS {_latest('placed', 'file_id, key, name')},
parts AS (SELECT file_id, level, token, key, count(*) AS cells, sum({_FRAME}) + max(octet_length(encode(key))) + 4 + 8 AS frame, max(ts) AS ts FROM files GROUP BY ALL),
stats AS (SELECT file_id, level, count(*) AS partition_count, sum(cells)::BIGINT AS cell_count, min(token) AS min_token, min_by(key, row(token, key)) AS min_key,
                 max(token) AS max_token, max_by(key, row(token, key)) AS max_key, (sum(frame) + 13)::BIGINT AS data_size_bytes, (max(ts) // 1000)::BIGINT AS created_at_ms
          FROM parts GROUP BY file_id, level),
catalog AS (SELECT *, row_number() OVER (ORDER BY file_id DESC) - 1 AS catalog_pos FROM stats)"""


def _places() -> str:
    """Where each asked key is looked for, and the trace of files visited."""
    return """
cand AS (SELECT a.key, c.level, c.file_id, c.created_at_ms, c.catalog_pos, row_number() OVER (PARTITION BY a.key, c.level ORDER BY c.catalog_pos) AS nth
         FROM asked a JOIN catalog c ON row(a.token, a.key) >= row(c.min_token, c.min_key) AND row(a.token, a.key) <= row(c.max_token, c.max_key)),
visits AS (SELECT key, file_id, row_number() OVER (PARTITION BY key ORDER BY level, CASE WHEN level = 0 THEN -created_at_ms ELSE 0 END, catalog_pos) AS place FROM cand WHERE level = 0 OR nth = 1),
holds AS (SELECT v.*, EXISTS (SELECT 1 FROM files f WHERE f.file_id = v.file_id AND f.key = v.key) AS holds FROM visits v),
visited AS (SELECT * FROM holds h WHERE NOT EXISTS (SELECT 1 FROM memory m WHERE m.key = h.key)
            AND NOT EXISTS (SELECT 1 FROM holds e WHERE e.key = h.key AND e.place < h.place AND e.holds))"""


def _positions() -> str:
    """g(h): the second hash, unsigned; sized(file_id, n, m, k)."""
    g = [f"xor(g, g >> {_u(24)})", _add("g", f"((g << {_u(3)}) & {_M})", f"((g << {_u(8)}) & {_M})"), f"xor(g, g >> {_u(14)})"]
    g += [_add("g", f"((g << {_u(2)}) & {_M})", f"((g << {_u(4)}) & {_M})"), f"xor(g, g >> {_u(28)})", _add("g", f"((g << {_u(31)}) & {_M})")]
    s = f"\ng0 AS (SELECT key, token, h, {_add(f'({_M} - h)', f'((h << {_u(21)}) & {_M})')} AS g FROM tokens),"
    for i, e in enumerate(g):
        s += f"\ng{i + 1} AS (SELECT key, token, h, {e} AS g FROM g{i}),"
    return s + """
file_keys AS (SELECT DISTINCT file_id, token, key FROM files),
sized0 AS (SELECT file_id, count(*) AS n, floor(-count(*) * ln(0.01) / (ln(2.0) * ln(2.0)))::BIGINT AS m FROM file_keys GROUP BY file_id),
sized AS (SELECT *, greatest(1, floor(m / n * ln(2.0) + 0.5))::INT AS k FROM sized0)"""


def _bits(source: str) -> str:
    """(file_id, key, bit) of (file_id, key) rows."""
    return f"(SELECT s.file_id, s.key, CAST((((x.h + i::UHUGEINT * x.g) % {_W}) & {_u((1 << 63) - 1)}) % z.m::UHUGEINT AS BIGINT) AS bit FROM {source} s JOIN g6 x USING (key) JOIN sized z USING (file_id), unnest(range(z.k)) r(i))"


_PROBED = f"""
filter AS (SELECT DISTINCT file_id, bit FROM {_bits('file_keys')}),
probed AS (SELECT p.file_id, p.key, bool_and(f.bit IS NOT NULL) AS might_contain FROM {_bits('probes')} p LEFT JOIN filter f ON f.file_id = p.file_id AND f.bit = p.bit GROUP BY ALL)"""


def _index(sample: int) -> str:
    """idx: entries of the sparse index, by walking each file."""
    return f"""
walk0 AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY token, key) AS n, coalesce(sum(frame) OVER (PARTITION BY file_id ORDER BY token, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 13 AS data_offset FROM parts),
walk AS (SELECT file_id, n, token, key, data_offset, true AS taken, 0::BIGINT AS since FROM walk0 WHERE n = 1
         UNION ALL
         SELECT w.file_id, w.n, w.token, w.key, w.data_offset, p.since + w.frame >= {sample}, CASE WHEN p.since + w.frame >= {sample} THEN 0 ELSE p.since + w.frame END::BIGINT
         FROM walk p JOIN walk0 w ON w.file_id = p.file_id AND w.n = p.n + 1),
idx AS (SELECT file_id, token, key, data_offset::BIGINT AS data_offset, row_number() OVER (PARTITION BY file_id ORDER BY n) - 1 AS entry FROM walk WHERE taken)"""


_SUMMARY = """
idx2 AS (SELECT *, (coalesce(sum(octet_length(encode(key)) + 10) OVER (PARTITION BY file_id ORDER BY entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 13)::BIGINT AS index_offset FROM idx),
summary AS (SELECT file_id, token, key, index_offset FROM idx2 WHERE entry % 4 = 0)"""

_BUCKETS = """
sorted AS (SELECT file_id, data_size_bytes, row_number() OVER (ORDER BY data_size_bytes, catalog_pos) AS n FROM catalog),
fold AS (SELECT file_id, data_size_bytes, n, 0 AS bucket, data_size_bytes AS first, 0 AS place FROM sorted WHERE n = 1
         UNION ALL
         SELECT s.file_id, s.data_size_bytes, s.n, CASE WHEN f.first / s.data_size_bytes >= 0.5 AND f.first / s.data_size_bytes <= 1.5 THEN f.bucket ELSE f.bucket + 1 END,
                CASE WHEN f.first / s.data_size_bytes >= 0.5 AND f.first / s.data_size_bytes <= 1.5 THEN f.first ELSE s.data_size_bytes END,
                CASE WHEN f.first / s.data_size_bytes >= 0.5 AND f.first / s.data_size_bytes <= 1.5 THEN f.place + 1 ELSE 0 END
         FROM fold f JOIN sorted s ON s.n = f.n + 1),
best AS (SELECT bucket, count(*) AS files, avg(data_size_bytes) AS mean_bytes FROM fold GROUP BY bucket HAVING count(*) >= 4 ORDER BY files DESC, mean_bytes DESC, bucket LIMIT 1),
plan AS (SELECT file_id, place AS input_pos, 0 AS output_level, 'size-tiered' AS reason FROM fold WHERE bucket IN (SELECT bucket FROM best) AND place < 32)"""

# Every file of level 0 goes down once there are four; what it overlaps on level 1 follows
# by growing the set of reached files to its fixed point.
_LCS_PLAN = """
reached AS (SELECT file_id, min_token, min_key, max_token, max_key, 0 AS kind, catalog_pos FROM catalog WHERE level = 0
            UNION
            SELECT c.file_id, c.min_token, c.min_key, c.max_token, c.max_key, 1, c.catalog_pos FROM catalog c JOIN reached r
              ON row(c.min_token, c.min_key) <= row(r.max_token, r.max_key) AND row(r.min_token, r.min_key) <= row(c.max_token, c.max_key) WHERE c.level = 1),
plan AS (SELECT file_id, row_number() OVER (ORDER BY kind, catalog_pos) - 1 AS input_pos, 1 AS output_level, 'level 0 is full' AS reason FROM reached)"""

# With three files of level 0, the level from 1 up that is most over its target (the lower
# of equals) gives its largest file, and what that overlaps one level down follows.
_LCS_OVER = f"""
larger AS (SELECT * REPLACE (data_size_bytes * {OVER} AS data_size_bytes) FROM catalog WHERE level > 0 OR file_id >= 12),
scores AS (SELECT level, sum(data_size_bytes) / (131072 * pow(10, level - 1)) AS score FROM larger WHERE level > 0 GROUP BY level),
top AS (SELECT level FROM scores WHERE score > 1 AND (SELECT count(*) FROM larger WHERE level = 0) < 4 ORDER BY score DESC, level LIMIT 1),
seed AS (SELECT * FROM larger WHERE level = (SELECT level FROM top) ORDER BY data_size_bytes DESC, catalog_pos LIMIT 1),
reached AS (SELECT file_id, level, min_token, min_key, max_token, max_key, 0 AS kind, catalog_pos FROM seed
            UNION
            SELECT c.file_id, c.level, c.min_token, c.min_key, c.max_token, c.max_key, 1, c.catalog_pos FROM larger c JOIN reached r
              ON row(c.min_token, c.min_key) <= row(r.max_token, r.max_key) AND row(r.min_token, r.min_key) <= row(c.max_token, c.max_key) WHERE c.level = (SELECT level + 1 FROM top)),
plan AS (SELECT file_id, row_number() OVER (ORDER BY kind, catalog_pos) - 1 AS input_pos, (SELECT level + 1 FROM top) AS output_level, 'level ' || (SELECT level FROM top) || ' is over its target' AS reason FROM reached)"""

_OUTPUT = f"""
input_cells AS (SELECT f.*, p.input_pos, p.output_level FROM files f JOIN plan p USING (file_id)),
output AS (SELECT key, token, output_level AS level, name, value, ts, flags, ttl, seq FROM {_latest('input_cells', 'key, name', 'ts DESC, input_pos')}
           WHERE NOT ({_purgeable(GRACE)} OR {_EXPIRED}))"""

_OUTPUT_STATS = f"""
out_parts AS (SELECT key, token, level, count(*) AS cells, sum({_FRAME}) + max(octet_length(encode(key))) + 12 AS frame FROM output GROUP BY ALL),
amplified AS (SELECT (SELECT sum(data_size_bytes) FROM catalog)::BIGINT AS bytes_flushed, (SELECT sum(data_size_bytes) FROM catalog WHERE file_id IN (SELECT file_id FROM plan))::BIGINT AS bytes_read,
                     (SELECT sum(s)::BIGINT FROM (SELECT sum(frame) + 13 AS s FROM out_parts GROUP BY level)) AS bytes_written)"""

_AMPLIFIED = "SELECT *, bytes_read - bytes_written AS bytes_reclaimed, round((bytes_flushed + bytes_written) / bytes_flushed, 9) AS amplification FROM amplified"
_OFFSETS = f"""
framed AS (SELECT *, {_FRAME} + octet_length(encode(key)) + 4 + 8 AS frame FROM mutations),
placed_log AS (SELECT *, (coalesce(sum(frame) OVER (PARTITION BY segment_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 32)::BIGINT AS offset_ FROM framed)"""
_ROLL = """
numbered AS (SELECT segment_id AS writer, seq, frame, row_number() OVER (PARTITION BY segment_id ORDER BY seq) AS n FROM framed),
roll AS (SELECT writer, seq, n, 0::BIGINT AS segment, 32 + frame AS total FROM numbered WHERE n = 1
         UNION ALL SELECT x.writer, x.seq, x.n, r.segment + CASE WHEN r.total >= 8192 THEN 1 ELSE 0 END, CASE WHEN r.total >= 8192 THEN 32 ELSE r.total END + x.frame
         FROM roll r JOIN numbered x ON x.writer = r.writer AND x.n = r.n + 1)"""
_REPLAY = "replayed AS (SELECT * FROM mutations m WHERE NOT EXISTS (SELECT 1 FROM mutations b WHERE b.segment_id = m.segment_id AND b.bad_crc AND b.seq <= m.seq))"
_READS = """
amp AS (SELECT (SELECT count(*) FROM asked) AS reads, (SELECT count(*) FROM asked a WHERE EXISTS (SELECT 1 FROM memory m WHERE m.key = a.key)) AS mem_hits,
               (SELECT count(*) FROM visited WHERE holds) AS sst_hits, (SELECT count(*) FROM visited) AS scanned)"""
_MEMORY_BYTES = "octet_length(encode(key)) + 16 + 2 * length(name) + coalesce(octet_length(encode(value)), 0) + 32"


def _tenths(unit: int) -> str:
    """n in units to one decimal, halves up."""
    t = f"((n * 10 + {unit // 2}) // {unit})"
    return f"{t} // 10 || '.' || {t} % 10"


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n"


def oracle_sql() -> dict[str, str]:
    m, v, g = _mutations(), _view(), _view(tied=True, files="generations")
    return {
        "memtable_merge": _with(m, _MERGED) + "SELECT key, name, value, ts, flags, ttl, seq FROM merged",
        "memtable_merge_ties": _with(_mutations(True), _MERGED) + "SELECT key, name, value, ts, flags, ttl, seq FROM merged",
        "lineitem_merge": """
            SELECT 'order:' || l_orderkey AS key, 'line' || l_linenumber AS name, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value, epoch_us(l_shipdate) AS ts
            FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS r FROM lineitem) WHERE r = 1""",
        "memtable_scan": _with(v) + "SELECT token, key, name, value, ts FROM memory JOIN tokens USING (key) WHERE tier = 0",
        "memtable_get": _with(v) + "SELECT key, name, value, ts, flags FROM memory WHERE tier = 0 AND key = 'user:000007'",
        "token_range_scan": _with(m, _MERGED, _tokens("mutations")) + f"SELECT token, key, name, value, ts FROM merged JOIN tokens USING (key) WHERE token BETWEEN {LOW_TOKEN} AND {HIGH_TOKEN}",
        "token_order": _with(m, _tokens("mutations")) + "SELECT key, token, row_number() OVER (ORDER BY token, key)::INT AS place FROM tokens",
        "key_token": _with(m, _tokens("mutations")) + "SELECT key, token FROM tokens",
        "log_replay_prefix": _with(m, _REPLAY) + "SELECT segment_id, seq, key, name, ts FROM replayed",
        "log_replay_stats": _with(m, _REPLAY) + "SELECT (SELECT count(DISTINCT segment_id) FROM mutations) AS segments, (SELECT count(*) FROM replayed) AS rows, (SELECT count(DISTINCT segment_id) FROM mutations WHERE bad_crc) AS corruptions",
        "log_offsets": _with(m, _OFFSETS) + 'SELECT segment_id, seq, frame::BIGINT AS frame, offset_ AS "offset" FROM placed_log',
        "segment_roll": _with(m, _OFFSETS, _ROLL) + "SELECT writer, seq, segment FROM roll",
        "last_good_position": _with(m, _OFFSETS) + """
            SELECT s.segment_id, coalesce(max(p.offset_ + p.frame), 32)::BIGINT AS position FROM (SELECT DISTINCT segment_id FROM mutations) s
            LEFT JOIN placed_log p ON p.segment_id = s.segment_id AND p.seq < coalesce((SELECT min(seq) FROM mutations b WHERE b.segment_id = s.segment_id AND b.bad_crc), 9223372036854775807) GROUP BY s.segment_id""",
        "segment_recycle": _with(m) + "SELECT DISTINCT segment_id, segment_id = 7 AS active FROM mutations WHERE segment_id > 5 OR segment_id = 7",
        "max_log_position": _with(m, _OFFSETS) + "SELECT segment_id, offset_ AS position FROM placed_log ORDER BY 1 DESC, 2 DESC LIMIT 1",
        "min_log_position": _with(m, _OFFSETS) + "SELECT segment_id, offset_ AS position FROM placed_log ORDER BY 1, 2 LIMIT 1",
        "encoded_size": _with(m, _MERGED) + f"SELECT key, (sum({_FRAME}) + max(octet_length(encode(key))) + 4)::BIGINT AS bytes FROM merged GROUP BY key",
        "cells_from_wide": """
            SELECT 'customer:' || c_custkey AS key, name, value, 0 AS flags FROM (
              SELECT c_custkey, 'c_name' AS name, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer
              UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer) WHERE value IS NOT NULL""",
        "tombstone_cells": _with(m) + f"SELECT DISTINCT key, name, CAST(NULL AS VARCHAR) AS value, CAST({NOW} AS BIGINT) AS ts, 1 AS flags FROM mutations WHERE seq % 10 = 9",
        "row_assembly": _with(m, _MERGED) + "SELECT key, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM merged GROUP BY key",
        "row_json": _with(m, _MERGED) + """
            SELECT key, '{"key":"' || key || '","cells":[' || string_agg('{"name":"' || name || '","value":' || coalesce('"' || value || '"', 'null') || ',"ts":' || ts || ',"tombstone":' || CASE WHEN flags & 1 <> 0 THEN 'true' ELSE 'false' END || '}', ',' ORDER BY name) || ']}' AS json
            FROM merged GROUP BY key""",
        "is_tombstone": _with(m) + "SELECT seq, key, name FROM mutations WHERE flags & 1 <> 0",
        "ttl_expired": _with(m) + f"SELECT seq, key, name, ts, ttl FROM mutations WHERE {_EXPIRED}",
        "live_view": _with(m, _MERGED) + f"SELECT key, name, value, ts FROM merged WHERE flags & 1 = 0 AND NOT {_EXPIRED}",
        "purgeable_tombstones": _with(m) + f"SELECT seq, key, name, ts FROM mutations WHERE {_purgeable(GRACE)}",
        "cell_render": _with(m) + "SELECT seq, CASE WHEN flags & 1 <> 0 THEN '<tombstone>' ELSE value END AS shown FROM mutations",
        "tombstone_purge": _with(m, _MERGED) + f"SELECT key, name, value, ts FROM merged WHERE NOT ({_purgeable(GRACE)} OR {_EXPIRED})",
        "tombstone_purge_safe": _with(v) + f"""
            SELECT key, name, ts, flags FROM {_latest("(SELECT * FROM files WHERE level = 0)", "key, name")} x
            WHERE NOT {_EXPIRED} AND NOT ({_purgeable(0)} AND NOT EXISTS (SELECT 1 FROM catalog c WHERE c.level = 1 AND x.token BETWEEN c.min_token AND c.max_token))""",
        "purged_rows": _with(m, _MERGED) + f"""
            SELECT coalesce(sum(gone), 0)::BIGINT AS cells_purged, count(*) FILTER (WHERE gone = cells) AS rows_emptied
            FROM (SELECT key, count(*) AS cells, count(*) FILTER (WHERE {_purgeable(0)} OR {_EXPIRED}) AS gone FROM merged GROUP BY key)""",
        "sstable_full_scan": _with(v) + "SELECT file_id, token, key, name, value, ts, flags FROM files",
        "sstable_statistics": _with(v) + "SELECT * FROM stats",
        "catalog_rebuild": _with(v) + "SELECT file_id, level, (row_number() OVER (ORDER BY CAST(file_id AS VARCHAR) DESC) - 1)::INT AS catalog_pos FROM (SELECT DISTINCT file_id, level FROM files)",
        "level_summary": _with(v) + "SELECT level, count(*) AS sstable_count, sum(data_size_bytes)::BIGINT AS total_bytes FROM catalog GROUP BY level",
        "range_prune": _with(v) + "SELECT a.key, c.file_id FROM asked a JOIN catalog c ON row(a.token, a.key) >= row(c.min_token, c.min_key) AND row(a.token, a.key) <= row(c.max_token, c.max_key)",
        "sstable_overlaps": _with(v) + "SELECT a.file_id, a.level, b.file_id AS other_id, b.level AS other_level FROM catalog a JOIN catalog b ON a.file_id < b.file_id AND row(a.min_token, a.min_key) <= row(b.max_token, b.max_key) AND row(b.min_token, b.min_key) <= row(a.max_token, a.max_key)",
        "level_overlap_check": _with(v) + "SELECT DISTINCT b.level, b.file_id FROM catalog a JOIN catalog b ON a.level = b.level AND a.level >= 1 AND a.file_id <> b.file_id AND row(a.min_token, a.min_key, a.file_id) <= row(b.min_token, b.min_key, b.file_id) AND row(b.min_token, b.min_key) <= row(a.max_token, a.max_key)",
        "sparse_index": _with(v, _index(512)) + "SELECT file_id, token, key, data_offset, entry FROM idx",
        "summary_index": _with(v, _index(256), _SUMMARY) + "SELECT file_id, token, key, index_offset FROM summary",
        "index_floor": _with(v, _index(512)) + "SELECT f.file_id, a.key, coalesce(max_by(i.data_offset, row(i.token, i.key)), -1) AS data_offset FROM (SELECT a.*, c.file_id FROM asked a JOIN catalog c ON row(a.token, a.key) >= row(c.min_token, c.min_key) AND row(a.token, a.key) <= row(c.max_token, c.max_key)) a JOIN (SELECT DISTINCT file_id FROM idx) f USING (file_id) LEFT JOIN idx i ON i.file_id = f.file_id AND row(i.token, i.key) <= row(a.token, a.key) GROUP BY f.file_id, a.key",
        "summary_floor": _with(v, _index(256), _SUMMARY) + """
            SELECT f.file_id, a.key, coalesce(max_by(i.index_offset, row(i.token, i.key)), (SELECT min(index_offset) FROM summary s WHERE s.file_id = f.file_id)) AS index_offset
            FROM (SELECT a.*, c.file_id FROM asked a JOIN catalog c ON row(a.token, a.key) >= row(c.min_token, c.min_key) AND row(a.token, a.key) <= row(c.max_token, c.max_key)) a JOIN (SELECT DISTINCT file_id FROM summary) f USING (file_id) LEFT JOIN summary i ON i.file_id = f.file_id AND row(i.token, i.key) <= row(a.token, a.key) GROUP BY f.file_id, a.key""",
        "bloom_sizing": "SELECT o_orderpriority, n, bits, greatest(1, floor(bits / n * ln(2.0) + 0.5))::INT AS hashes FROM (SELECT o_orderpriority, count(*) AS n, floor(-count(*) * ln(0.01) / (ln(2.0) * ln(2.0)))::BIGINT AS bits FROM orders GROUP BY 1)",
        "bloom_build": _with(v, _positions()) + f"SELECT DISTINCT file_id, bit FROM {_bits('file_keys')}",
        "bloom_probe": _with(v, _positions(), "\nprobes AS (SELECT a.key, c.file_id FROM asked a JOIN catalog c ON c.level = 0 AND row(a.token, a.key) >= row(c.min_token, c.min_key) AND row(a.token, a.key) <= row(c.max_token, c.max_key))", _PROBED) + "SELECT file_id, key, might_contain FROM probed",
        "bloom_fpp": _with(v, _positions()) + "SELECT file_id, n AS keys, m AS bits, k AS hashes, round(pow(1 - exp(-k * n / m), k), 9) AS fpp FROM sized",
        "read_first_hit": _with(v, _places()) + """
            SELECT m.key, name, value, ts, flags, tier FROM memory m JOIN asked USING (key) WHERE tier = (SELECT min(tier) FROM memory o WHERE o.key = m.key)
            UNION ALL SELECT f.key, f.name, f.value, f.ts, f.flags, 2 FROM files f JOIN visited x ON x.holds AND x.file_id = f.file_id AND x.key = f.key""",
        "read_reconciled": _with(v) + f"SELECT key, name, value, ts, flags, ttl, seq FROM {_latest('(SELECT m.* FROM mutations m JOIN asked USING (key))', 'key, name')}",
        "multi_get": _with(v, _MERGED) + "SELECT key, name, value, ts FROM merged WHERE key IN (SELECT key FROM asked)",
        "sstable_lookup_trace": _with(v, _places(), _positions(), "\nprobes AS (SELECT key, file_id FROM visited)", _PROBED) + "SELECT key, file_id, place::INT AS place, might_contain, holds FROM visited JOIN probed USING (key, file_id)",
        "lookup_counters": _with(v, _places(), _positions(), "\nprobes AS (SELECT key, file_id FROM visited)", _PROBED) + """
            SELECT count(*) AS scanned, count(*) FILTER (WHERE might_contain) AS bloom_hits, count(*) FILTER (WHERE NOT might_contain) AS bloom_misses,
                   count(*) FILTER (WHERE holds) AS found, count(*) FILTER (WHERE might_contain AND NOT holds) AS false_positives FROM visited JOIN probed USING (key, file_id)""",
        "read_amplification": _with(v, _places(), _READS) + "SELECT reads, mem_hits, sst_hits, scanned, CASE WHEN reads > mem_hits THEN round(scanned / (reads - mem_hits), 9) ELSE 0.0 END AS scans_per_read FROM amp",
        "memtable_size": _with(m) + f"SELECT generation, sum({_MEMORY_BYTES})::BIGINT AS estimated_bytes, count(*) AS puts FROM mutations GROUP BY generation",
        "flush_due": _with(m) + f"SELECT generation, sum({_MEMORY_BYTES})::BIGINT AS estimated_bytes, count(*) AS puts, sum({_MEMORY_BYTES}) >= 32768 AS due FROM mutations GROUP BY generation",
        "engine_stats": _with(v, _places(), _READS) + """
            SELECT (SELECT count(*) FROM mutations) AS writes, (SELECT count(DISTINCT segment_id) FROM mutations) AS log_segments, (SELECT count(DISTINCT generation) FROM mutations) AS memtables,
                   (SELECT count(*) FROM catalog) AS sstables, (SELECT sum(data_size_bytes)::BIGINT FROM catalog) AS sstable_bytes, reads, mem_hits, sst_hits, scanned,
                   round((mem_hits + sst_hits) / reads, 9) AS hit_ratio FROM amp""",
        "stats_rate": _with(m) + """
            SELECT 'writes' AS counter, at_ms, total, round(greatest(0.0, (total - lag(total) OVER w) * 1000.0::DOUBLE / greatest(1, at_ms - lag(at_ms) OVER w)), 9) AS rate
            FROM (SELECT max(seq) AS total, (max(ts) // 1000)::BIGINT AS at_ms FROM mutations GROUP BY seq // 500) WINDOW w AS (ORDER BY at_ms)""",
        "stcs_buckets": _with(v, _BUCKETS) + "SELECT file_id, data_size_bytes, bucket, place FROM fold",
        "stcs_select": _with(g, _BUCKETS) + "SELECT bucket, files, mean_bytes FROM best",
        "stcs_plan": _with(g, _BUCKETS) + "SELECT file_id, input_pos, output_level, reason FROM plan",
        "compaction_merge": _with(g) + f"SELECT key, name, value, ts, flags, ttl, seq FROM {_latest('files', 'key, name', 'ts DESC, file_id * 7 % 16')}",
        "stcs_compact": _with(g, _BUCKETS, _OUTPUT) + "SELECT key, token, level, name, value, ts, flags, ttl, seq FROM output",
        "lcs_level_scores": _with(v) + "SELECT level, sum(data_size_bytes)::BIGINT AS total_bytes, (131072 * pow(10, level - 1))::BIGINT AS target_bytes, round(sum(data_size_bytes) / (131072 * pow(10, level - 1)), 9) AS score FROM catalog WHERE level >= 1 GROUP BY level",
        "lcs_overlap_closure": _with(v, """
            reached AS (SELECT file_id, min_token, min_key, max_token, max_key FROM catalog WHERE file_id = 100
                        UNION SELECT c.file_id, c.min_token, c.min_key, c.max_token, c.max_key FROM catalog c JOIN reached r ON row(c.min_token, c.min_key) <= row(r.max_token, r.max_key) AND row(r.min_token, r.min_key) <= row(c.max_token, c.max_key) WHERE c.level > 0)""") + "SELECT * FROM reached WHERE file_id <> 100",
        "lcs_plan": _with(v, _LCS_PLAN) + "SELECT file_id, input_pos::INT AS input_pos, output_level, reason FROM plan",
        "lcs_compact": _with(v, _LCS_PLAN, _OUTPUT) + "SELECT key, token, level, name, value, ts, flags, ttl, seq FROM output",
        "compaction_cycle": _with(g, _BUCKETS, _OUTPUT, _OUTPUT_STATS) + """
            SELECT file_id, level, partition_count, cell_count, data_size_bytes FROM stats WHERE file_id NOT IN (SELECT file_id FROM plan)
            UNION ALL SELECT 1000, level, count(*), sum(cells)::BIGINT, (sum(frame) + 13)::BIGINT FROM out_parts GROUP BY level""",
        "write_amplification": _with(g, _BUCKETS, _OUTPUT, _OUTPUT_STATS) + _AMPLIFIED,
        "strategy_comparison": "WITH s AS (" + _with(g, _BUCKETS, _OUTPUT, _OUTPUT_STATS) + _AMPLIFIED + "), l AS (" + _with(g, _LCS_PLAN, _OUTPUT, _OUTPUT_STATS) + _AMPLIFIED + ") "
        + " UNION ALL ".join(f"SELECT '{c}' AS metric, round(s.{c}::DOUBLE, 9) AS stcs, round(l.{c}::DOUBLE, 9) AS lcs FROM s, l" for c in ("bytes_flushed", "bytes_read", "bytes_written", "bytes_reclaimed", "amplification")),
        "log_metrics": _with(m, _OFFSETS, _ROLL) + f"SELECT count(*) AS writes, sum({_MEMORY_BYTES})::BIGINT AS estimated_bytes, (SELECT sum(s)::BIGINT FROM (SELECT max(segment) AS s FROM roll GROUP BY writer)) AS rolls FROM mutations",
        "file_age": _with(v) + f"SELECT file_id, trunc(({NOW // 1000} - created_at_ms) / 1000)::BIGINT AS age_seconds FROM catalog",
        "filter_memory": _with(v, _positions()) + "SELECT file_id, m AS bits, (m + 63) // 64 * 8 AS memory_bytes FROM sized",
        "tier_share": _with(v, _places(), _READS) + "SELECT " + ", ".join(f"floor({n} * 100.0 / greatest(1, reads) + 0.5)::BIGINT AS {c}" for n, c in (("mem_hits", "memory_percent"), ("sst_hits", "files_percent"), ("(reads - mem_hits - sst_hits)", "miss_percent"))) + " FROM amp",
        "lcs_plan_over_target": _with(v, _LCS_OVER) + "SELECT file_id, input_pos::INT AS input_pos, output_level, reason FROM plan",
        "key_token_long": _with("long_keys AS (SELECT DISTINCT c_name AS key FROM customer WHERE octet_length(encode(c_name)) BETWEEN 16 AND 31)", _tokens("long_keys", block=True)) + "SELECT key, token FROM tokens",
        "abbreviations": "SELECT o_orderkey, n, " + ", ".join(
            f"CASE WHEN n >= {m} THEN {_tenths(m)} || '{sm}' WHEN n >= {k} THEN {_tenths(k)} || '{sk}' ELSE n || '{s}' END AS {c}" for c, m, k, sm, sk, s in (("short", 1_000_000, 1_000, "M", "K", ""), ("size", 1 << 20, 1 << 10, " MB", " KB", " B"))
        ) + " FROM (SELECT o_orderkey, floor(o_totalprice * o_orderkey / 100)::BIGINT AS n FROM orders)",
        "query_decode": "SELECT c_custkey, c_name AS key, 'a b&c' AS x_y, 'é' AS key2, 3::BIGINT AS names FROM customer",
        "crc32c": """
            WITH t AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 2197175160) ELSE a >> 1 END)) AS crcs),
            p AS (SELECT p_partkey, hex(encode(p_name)) AS x FROM part),
            b AS (SELECT p_partkey, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT)) AS bytes FROM p)
            SELECT p_partkey, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, crcs[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295)::BIGINT AS crc FROM b, t""",
        "blast_rows": "SELECT 'user:' || lpad(CAST(i AS VARCHAR), 6, '0') AS key, 'email' AS name, 'user' || i || '@example.org' AS value FROM range(2000) r(i)",
    }
