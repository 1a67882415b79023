"""The 64-bit token of a key, Bloom positions and CRC-32C.

Tokens need multiplication that wraps. An expression keeps the overflow mode with which
it was analysed, so steps are analysed here with ANSI mode off and work under any mode.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seeds and multipliers of the token (Murmur3 x64, two different seeds).
SEED_1, SEED_2 = 0x9368E53C2F6AF274, 0x586DCD208F7CD3FD
C1, C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
ADD_1, ADD_2 = 0x52DCE729, 0x38495AB5
MIX_1, MIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def _long(x: int) -> str:
    """A 64-bit pattern as a signed literal."""
    x = x - (1 << 64) if x >> 63 else x
    return f"{x}L" if x != -(1 << 63) else "(-9223372036854775807L - 1L)"


def _rot(x: str, r: int) -> str:
    return f"(shiftleft({x}, {r}) | shiftrightunsigned({x}, {64 - r}))"


def _little(hexes: str, at: str) -> str:
    """Eight bytes of a hex string, from character at (1-based), as a little-endian long."""
    pairs = ", ".join(f"substr({hexes}, {at} + {2 * i}, 2)" for i in range(7, -1, -1))
    return f"cast(conv(concat({pairs}), 16, -10) as bigint)"


def _let(value: str, name: str, body: str) -> str:
    """body with name for value. A lambda's variable stands for the value however often the
    body names it, and also where a filter takes the expression along to the scan, so that
    expressions grow with their number of steps and do not double with each."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _spin(k: str, first: int, turn: int, then: int) -> str:
    return _let(f"{k} * {_long(first)}", "_y", f"{_rot('_y', turn)} * {_long(then)}")


def _mixed(h: str) -> str:
    # The shift widths.
    return f"aggregate(array({_long(MIX_1)}, {_long(MIX_2)}, 1L), {h}, (_a, _m) -> (_a ^ shiftrightunsigned(_a, 33)) * _m)"


def wrapping(df: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """Add columns by SQL expressions with wrapping arithmetic."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.ansi.enabled")
    conf.set("spark.sql.ansi.enabled", "false")
    try:
        for name, sql in steps:
            df = df.withColumn(name, F.expr(sql))
        df.schema  # noqa: B018  analysis happens here
    finally:
        conf.set("spark.sql.ansi.enabled", before)
    return df


def with_token(df: DataFrame, key: str = "key", out: str = "token") -> DataFrame:
    """Add the token of a string or binary key; that of a null key is 0, so that a token is
    never null and no join has to ask."""
    blocks = f"transform(if(_k.n > 0, sequence(0, _k.n - 1), cast(array() as array<int>)), i -> named_struct('x', {_little('_k.x', '32 * i + 1')}, 'y', {_little('_k.x', '32 * i + 17')}))"
    # The turns of each step.
    a = f"({_rot('_a', 27)} + _s.b) * 5L + {_long(ADD_1)}"
    b = f"({_rot('_b', 31)} + _n.a) * 5L + {_long(ADD_2)}"
    a = _let(f"_s.a ^ {_spin('_x.x', C1, 31, C2)}", "_a", a)
    b = _let(f"_s.b ^ {_spin('_x.y', C2, 33, C1)}", "_b", b)
    step = _let(f"named_struct('a', {a})", "_n", f"named_struct('a', _n.a, 'b', {b})")
    hashed = f"aggregate({blocks}, named_struct('a', {_long(SEED_1)}, 'b', {_long(SEED_2)}), (_s, _x) -> {step})"
    tail = "rpad(substr(_k.x, 32 * _k.n + 1), 32, '0')"
    ends = f"named_struct('a', _h.a ^ {_spin(_little('_t', '1'), C1, 31, C2)} ^ _k.len, 'b', _h.b ^ {_spin(_little('_t', '17'), C2, 33, C1)} ^ _k.len)"
    ends = _let(hashed, "_h", _let(tail, "_t", ends))
    token = _let(ends, "_e", f"{_mixed('(_e.a + _e.b)')} + {_mixed('(_e.a + 2L * _e.b)')}")
    length = f"cast(octet_length({key}) as bigint)"
    whole = _let(f"named_struct('x', hex(cast({key} as binary)), 'len', {length}, 'n', cast({length} div 16 as int))", "_k", token)
    return wrapping(df, [(out, f"coalesce({whole}, 0L)")])


def bloom_size(n: int, fpp: float = 0.01) -> tuple[int, int]:
    """(bits, hash functions) for n keys."""
    p = fpp or 5e-324
    m = int(-n * math.log(p) / math.log(2) ** 2)
    return m, max(1, math.floor(m / n * math.log(2) + 0.5))


def bloom_size_columns(n: Column, fpp: float = 0.01) -> tuple[Column, Column]:
    m = F.floor(-n * F.lit(math.log(fpp)) / F.lit(math.log(2) ** 2))
    return m, F.greatest(F.lit(1), F.floor(m / n * F.lit(math.log(2)) + 0.5)).cast("int")


def with_bloom_positions(df: DataFrame, bits: str = "bits", hashes: str = "hashes", out: str = "positions") -> DataFrame:
    """Add the bit positions of each row's token in a filter of `bits` bits."""
    # Shift widths and factors of the second hash (x + (x << 3) + (x << 8) is 265 x, and so on).
    second = "aggregate(array(named_struct('r', 24, 'm', 265L), named_struct('r', 14, 'm', 21L), named_struct('r', 28, 'm', 2147483649L)), token * 2097151L - 1L, (_a, _m) -> (_a ^ shiftrightunsigned(_a, _m.r)) * _m.m)"
    found = _let(second, "_g", f"transform(sequence(0, {hashes} - 1), i -> ((token + cast(i as bigint) * _g) & 9223372036854775807L) % {bits})")
    return wrapping(df, [(out, found)])


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    return t


def crc32c(data: bytes, table: np.ndarray | None = None) -> int:
    t = (_crc_table() if table is None else table).tolist()
    c = 0xFFFFFFFF
    for b in data:
        c = (c >> 8) ^ t[(c ^ b) & 255]
    return c ^ 0xFFFFFFFF


def with_crc32c(df: DataFrame, data: str, out: str = "crc") -> DataFrame:
    """Add the CRC-32C of a binary column, all rows of an Arrow batch at once, byte by
    byte position."""
    fields = [*df.schema.fieldNames(), out]
    schema = ", ".join([df.schema.toDDL(), f"`{out}` long"])

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1)
        for b in rows:
            values = [x or b"" for x in b.column(data).to_pylist()]
            size = np.array([len(v) for v in values], np.int64)
            raw = np.frombuffer(b"".join(values), np.uint8)
            start = np.cumsum(size) - size
            crc, alive, k = np.full(len(values), 0xFFFFFFFF, np.uint32), np.flatnonzero(size), 0
            while len(alive):
                crc[alive] = (crc[alive] >> 8) ^ table[(crc[alive] ^ raw[start[alive] + k]) & 255]
                k += 1
                alive = alive[size[alive] > k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((crc ^ 0xFFFFFFFF).astype(np.int64))], fields)

    return df.mapInArrow(run, schema)
