"""Query logs as a stream (an extension): windowed counts, and pushes batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """events (ts, event_type) as counts of each tumbling window; later rows than late are dropped."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Pushed rows appended to a log, each batch once: a batch that is tried again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
