"""Streaming ingestion: every micro-batch becomes cells and is merged into a store.

Micro-batches are aggregated statelessly and committed with their batch id, so
events may arrive as late as they like, no state grows, and a batch that is
delivered again after a failure is committed once.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridroll.operators.fanout import build_cells
from gridroll.session import ship

#: How a write waits for its flush: own flush at once, shared flush, not at all.
FULL_SYNC, BATCH_SYNC, BATCH_ASYNC = "FULL_SYNC", "BATCH_SYNC", "BATCH_ASYNC"
SYNC_LEVELS = (FULL_SYNC, BATCH_SYNC, BATCH_ASYNC)


def write_stream(stream: DataFrame, store: Any, checkpoint: str, sync: str = BATCH_ASYNC, interval: str = "10 seconds", writer: str | None = None) -> StreamingQuery:
    """Start merging a stream of input rows into ``store``.

    BATCH_ASYNC returns at once and flushes every ``interval``; BATCH_SYNC and
    FULL_SYNC take in what is there, in bounded batches, and return when it is
    committed. The first failing batch ends the query: ``exception()`` has the
    cause, and nothing is written after it until the query is started again.
    Size thresholds are the source's (maxFilesPerTrigger, maxOffsetsPerTrigger).
    """
    if sync not in SYNC_LEVELS:
        raise ValueError(f"unknown sync level {sync!r}")
    ship(stream.sparkSession)
    name = writer or checkpoint

    def flush(batch: DataFrame, batch_id: int) -> None:
        store.merge(build_cells(store.spec, batch), writer=name, batch_id=batch_id)

    out = stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    if sync == BATCH_ASYNC:
        return out.trigger(processingTime=interval).start()
    query = out.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
