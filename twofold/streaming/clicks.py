"""Clicks as a stream: the batch aggregate of the click table, kept up to date; an extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_clicks(events: DataFrame, late: str = "1 day", window: str | None = None) -> DataFrame:
    """Clicks of each user and event type, in update mode; with `window`, of each window, whose state the watermark ends."""
    stream = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    keys = [F.col("user_id"), F.col("event_type")]
    if window:
        keys.append(F.window("ts", window).alias("window"))
    out = stream.groupBy(*keys).agg(F.count("*").alias("sum_click"))
    return out.select("user_id", "event_type", F.col("window.start").alias("start"), "sum_click") if window else out


def write_updates(counts: DataFrame, path: str, checkpoint: str):
    """Each batch's changed counts as Parquet under its number; a repeated batch overwrites its own folder."""
    return (
        counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"))
        .trigger(availableNow=True).start()
    )
