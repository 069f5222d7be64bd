"""Streaming ingest: each micro-batch of a stream of units is inserted into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the query.  Batches that were taken before a restart are known by their number and passed over."""

    def take(batch: DataFrame, number: int) -> None:
        if number > store.state.get("stream", -1) and not batch.isEmpty():
            store.insert(batch, stream=number)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
