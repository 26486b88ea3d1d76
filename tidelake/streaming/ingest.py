"""Structured Streaming into an engine: each micro-batch lands once and is flushed when due."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def ingest_stream(engine: Engine, records: DataFrame, checkpoint: str, name: str = "ingest", interval: str | None = None, flush_each: bool = False, now_us: int | None = None, order: str | None = None) -> StreamingQuery:
    """Lands a stream of records (columns of model.RECORD).

    A batch that Spark runs again after a crash is known by the query's id, which
    its checkpoint keeps, and its number, and lands once. ``interval`` is a processing time; without it all that is available is
    read and the query ends. Records of any age are taken while they are in the
    accept window: there is no watermark, and late ones go to their own hours.
    A source that reads several files at once has no order of rows: ``order``
    names a column that has it, as for append_raw().
    """

    def land(batch: DataFrame, number: int) -> None:
        # A session of the stream alone. Landing keeps a file open for each series and epoch, so no task sorts its rows by them; beyond so many it does.
        batch.sparkSession.conf.set("spark.sql.maxConcurrentOutputFileWriters", "16")
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        engine.append_raw(batch, now_us, source=f"{name}.{query}-{number}", order=order)
        if flush_each or (engine.config.flush.interval_ms and engine.overdue()):
            engine.flush()

    writer = records.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def drain(query: StreamingQuery, seconds: float = 5.0) -> bool:
    """Reads what has arrived, for so long at most, and stops the query; whether all was read."""
    worker = threading.Thread(target=query.processAllAvailable, daemon=True)
    worker.start()
    worker.join(seconds)
    done = not worker.is_alive()
    query.stop()
    return done
