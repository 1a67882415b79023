"""Schemas, flags and settings of a versioned cell log.

A cell is (key, name, value, ts in microseconds, flags, ttl in seconds, seq); seq is the
order of arrival. Rows are sparse and schemaless: the cell log is the canonical form.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

# Flags of a cell and the settings that results depend on.
TOMBSTONE, EXPIRING = 1, 2
SEGMENT_BYTES = 32 << 20
MEMTABLE_BYTES = 8 << 20
INDEX_SAMPLE_BYTES = 4096
SUMMARY_SAMPLE = 128
BLOOM_FPP = 0.01
STCS_LOW, STCS_HIGH, STCS_LEAST, STCS_MOST = 0.5, 1.5, 4, 32
LCS_L0_FILES, LCS_L1_BYTES, LCS_FANOUT = 4, 131072, 10
FRAME_BYTES, FILE_HEADER_BYTES, INDEX_ENTRY_BYTES, MOST_RECORD_BYTES = 8, 13, 10, 64 << 20

CELL = "key string, name string, value string, ts long, flags int, ttl int, seq long"


@dataclass(frozen=True)
class Settings:
    """How a store behaves; the environment gives defaults. Both sync modes get what BATCH
    promises: a write that has returned is durable."""

    strategy: str = field(default_factory=lambda: os.environ.get("COMPACTION_STRATEGY", "STCS").upper())
    sync_mode: str = field(default_factory=lambda: os.environ.get("COMMITLOG_SYNC_MODE", "PERIODIC").upper())
    memtable_bytes: int = MEMTABLE_BYTES
    grace_seconds: int = 0

    def __post_init__(self) -> None:
        if self.strategy not in ("STCS", "LCS") or self.sync_mode not in ("PERIODIC", "BATCH"):
            raise ValueError(f"unknown strategy or sync mode: {self.strategy}, {self.sync_mode}")
