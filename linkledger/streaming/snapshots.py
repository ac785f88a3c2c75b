"""Inventory snapshots as a stream of micro-batches, and event-time windows as an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_stream(source: DataFrame, path: str, checkpoint: str, every: str | None = "15 minutes"):
    """Each micro-batch is one snapshot: its rows are written first, its status row last, so that a batch that fails leaves
    no `ok` but a row `failed` with the reason. A batch that is tried again overwrites its own partition."""

    def save(batch: DataFrame, number: int) -> None:
        def state(rows: DataFrame) -> None:
            rows.write.mode("overwrite").parquet(f"{path}/snapshots/snapshot_id={number}")

        rows = batch.withColumn("snapshot_id", F.lit(number))
        try:
            rows.write.mode("overwrite").parquet(f"{path}/interfaces/snapshot_id={number}")
        except Exception as e:
            error = str(e)[:1000]
            state(batch.sparkSession.range(1).select(F.lit(0).cast("long").alias("interface_count"), F.lit(0).cast("long").alias("device_count"), F.lit("failed").alias("status"), F.lit(error).alias("error")))
            raise
        stored = batch.sparkSession.read.parquet(f"{path}/interfaces/snapshot_id={number}")
        state(stored.agg(F.count("*").alias("interface_count"), F.countDistinct("user_id").alias("device_count"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error")))

    writer = source.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed_events(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type; on a stream, rows later than `late` are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
