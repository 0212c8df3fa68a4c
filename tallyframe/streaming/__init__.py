"""Live ingest: micro-batches are added to a database as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..database import Database


def ingest_stream(stream: DataFrame, database: Database, checkpoint: str, name: str = "default", mapping: dict[str, str] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Counts are additive, so late rows just add to their key. A batch's number is committed with its counts, so a
    batch that is replayed after a failure is not counted twice."""

    def add(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            database.ingest(held, mapping, stream=(name, number))
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
