"""Continuous last-write-wins.

Late data is never dropped: a timestamp decides whenever a cell is met, so there is no
watermark on this state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.reconcile import memtable_merge
from ..sources.storage import CellStore


def merged_stream(cells: DataFrame) -> DataFrame:
    """The winners so far of a stream of cells; write it in complete or update mode."""
    return memtable_merge(cells)


def ingest(cells: DataFrame, store: CellStore, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each micro-batch to the store's log and flush when due. Finished batches are
    marked and passed over when tried again; one that was written but not yet marked is
    written again, to the same winners."""
    spark = store.spark

    def one(batch: DataFrame, number: int) -> None:
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{store.root}/batches/{number:010d}")
        fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(done):
            return
        if batch.take(1):
            store.write(batch)
        fs.create(done).close()
        if store.flush_due():
            store.force_flush()

    return cells.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
