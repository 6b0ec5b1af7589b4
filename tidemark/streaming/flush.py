"""Streaming ingest: every micro-batch becomes one commit.

A batch goes past the buffer to parts of its own, and its number is part of the commit that makes them visible. A batch
that fails leaves nothing behind, one that Spark runs again after its commit is dropped, and flushes in between don't touch
it: exactly once from the source's checkpoint to the parts. There are no watermarks; samples of any
age land in the part of their own day. Unlike the buffer of ``Database.append``, a batch is visible once
it is committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.database import Database


def start(db: Database, stream: DataFrame, name: str, checkpoint: str, seconds: float | None = None, once: bool = False) -> StreamingQuery:
    """Commits (labels, ts_ms, value) rows of a stream; ``once`` takes what is there and stops."""

    def flush(batch: DataFrame, number: int) -> None:
        db.write_batch(batch, (name, number))

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(flush)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds or db.config.flush_seconds} seconds")
    return writer.start()
