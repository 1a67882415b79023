"""Compaction planning and execution."""
