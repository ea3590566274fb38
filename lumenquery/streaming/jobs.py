"""Structured Streaming jobs: ingest without repeats, backfill against a ledger, windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def distinct_arrivals(stream: DataFrame, key: str = "hash", at: str = "arrived", delay: str = "1 day") -> DataFrame:
    """The first arrival of each content within the watermark (ST3)."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def backfill(stream: DataFrame, ledger: str, results: str, work: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "asset_id") -> StreamingQuery:
    """Run work on arrivals that the ledger doesn't hold, then record them, found or not (ST1, ST2).

    Results go out before the ledger, so a failure between leaves the items queued; the
    batch number is a partition, so that a repeated batch replaces what it wrote.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark: SparkSession = df.sparkSession
        try:
            done = spark.read.parquet(ledger).where(F.col("batch") != number).select(key)
        except Exception as e:  # the first batch finds no ledger
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = spark.createDataFrame([], df.select(key).schema)
        todo = df.dropDuplicates([key]).join(done, key, "left_anti")
        work(todo).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(results)
        todo.select(key, F.current_timestamp().alias("at"), F.lit(number).alias("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(ledger)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Count and mean of value per window and type (ST6; an extension on batch or stream)."""
    e = events.withWatermark("ts", delay) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Counts over overlapping windows (an extension)."""
    e = events.withWatermark("ts", delay) if events.isStreaming else events
    return e.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of a user's events without a gap (ST7; an extension)."""
    e = events.withWatermark("ts", delay) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")).select("user_id", F.col("w.start").alias("start"), "last", "n")
