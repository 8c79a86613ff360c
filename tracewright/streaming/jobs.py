"""Refresh jobs as a stream of events. An extension: the service this follows keeps a queue and no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewright.operators.rank import latest


def windowed_counts(events: DataFrame, at: str = "ts", key: str = "event_type", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and key; those later than the watermark are dropped, which bounds the state."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def keep_latest(events: DataFrame, path: str, checkpoint: str, key: str, at: str, tie: str) -> StreamingQuery:
    """Keep the latest event of each key in ``path/<batch>``: each batch merges into what the one before it wrote.

    A batch that runs again writes the same folder from the same predecessor, so the result does not depend on it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        held = batch.select(key, at, tie)
        if number:
            held = held.unionByName(batch.sparkSession.read.parquet(f"{path}/{number - 1}").select(key, at, tie))
        latest(held, key, at, tie).write.mode("overwrite").parquet(f"{path}/{number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
