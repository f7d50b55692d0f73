"""Streams into tables: each micro-batch is one write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.table import LedgerTable

BATCH = "last_batch"


def ingest(stream: DataFrame, table: LedgerTable, deleted: str, order: list[str], checkpoint: str, query: str = "ingest", available_now: bool = True) -> StreamingQuery:
    """Starts a query that applies a stream of changes to ``table``, each batch by newest arrival.

    The table's manifest remembers the last batch of each ``query`` name, so a batch that runs again after a failure is
    not written twice. Late rows win, as any later arrival does; ``order`` decides inside a batch only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        table.refresh()
        done = table.manifest.notes.get(f"{query}.{BATCH}", -1)
        if batch_id > done:
            table.manifest.notes[f"{query}.{BATCH}"] = batch_id
            table.apply(batch.withColumn(deleted, F.coalesce(F.col(deleted), F.lit(False))), deleted, order)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
