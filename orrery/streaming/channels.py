"""Channels and change capture on Structured Streaming.

A channel is a folder of JSON lines with a declared payload. `notify` appends to it, `listen` reads it as a stream. A
signal calls a handler for each batch of changes, again up to five times if it fails; handlers that took a batch
are noted, so a restart from the checkpoint gives them no batch twice. `bucketed` counts events by time, an addition of this engine.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTEMPTS = 5


class Channel:
    def __init__(self, spark: SparkSession, name: str, path: str, payload: str):
        self.spark, self.name, self.path, self.payload = spark, name, path.rstrip("/"), payload

    def notify(self, rows: DataFrame) -> None:
        rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(f"{self.path}/{self.name}")

    def listen(self) -> DataFrame:
        lines = self.spark.readStream.schema("value string").text(f"{self.path}/{self.name}")
        return lines.select(F.from_json("value", self.payload).alias("p")).select("p.*")


def signal(changes: DataFrame, handler: Callable[[DataFrame], None], checkpoint: str, wait: float = 30.0):
    """A running query that hands each micro-batch to the handler, at least once."""

    def batch(df: DataFrame, number: int) -> None:
        for attempt in range(ATTEMPTS):
            try:
                return handler(df)
            except Exception:
                if attempt == ATTEMPTS - 1:
                    raise
                time.sleep(wait * 2 ** min(attempt, 3))

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def coalesced(outbox: DataFrame, *keys: str) -> DataFrame:
    """One claim for each key of a batch of an outbox."""
    return outbox.dropDuplicates(list(keys))


def bucketed(events: DataFrame, time_col: str, every: str, late: str, *by: str) -> DataFrame:
    """Counts by window of event time; rows later than `late` behind the latest are left to the watermark."""
    stamped = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    counts = stamped.groupBy(F.window(time_col, every), *by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), *by, "n")
