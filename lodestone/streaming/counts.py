"""Counts of configurations maintained from a stream; they add up, so tables of probabilities follow at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def maintain_counts(stream: DataFrame, columns: list[str], folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the counts of each micro-batch under its number, so that a batch that is tried again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*columns).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    started = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if available_now else started).start()


def current_counts(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(folder).groupBy(*columns).agg(F.sum("n").alias("n"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by type and window; batches and streams alike, rows later than `late` dropped from streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
