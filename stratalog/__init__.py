"""Versioned cell-log analytics on PySpark."""
