"""Streams into snapshot tables: every micro-batch is one published snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.store import Store


def append_stream(store: Store, table: str, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to a table. A batch's number is in the manifest that publishes its rows, so a batch that
    is tried again after a crash is skipped if it was published."""

    def publish(batch: DataFrame, number: int) -> None:
        store.insert(table, batch, number)

    writer = stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
