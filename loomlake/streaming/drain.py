"""The staging queue as a stream: drain what is pending, then stop; or keep event counts by window."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drain_staging(spark: SparkSession, ingest, checkpoint: str) -> dict:
    """Process uploads whose metadata files the stream has not seen; each is done once, even over restarts."""
    totals = {"success": 0, "failed": 0}
    pending = Path(ingest.root) / "staging/pending"

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            out = ingest.process_pending()
            totals["success"] += out["success"]
            totals["failed"] += out["failed"]

    source = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "upload_metadata.json").load(f"{pending}/*/")
    source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(batch).start().awaitTermination()
    return totals


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events for each window and type; rows later than the watermark are left out when it is a stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    return stream.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what a stream has so far as Parquet, exactly once."""
    df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(path).awaitTermination()


def wait_for(condition, timeout: float = 60, poll: float = 0.1) -> bool:
    end = time.monotonic() + timeout
    while not condition():
        if time.monotonic() > end:
            return False
        time.sleep(poll)
    return True
