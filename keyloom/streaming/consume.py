"""Streams over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schema of an event file; streams don't infer theirs.
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def follow(spark: SparkSession, folder: str, schema: str = EVENTS, files_at_a_time: int = 1) -> DataFrame:
    """Blocking read: entries as files arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_a_time).parquet(folder)


def rate(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Entries of each stream in a window; late ones count until the watermark passes."""
    e = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)
    return e.groupBy(F.window("t", window), "event_type").agg(F.count("*").alias("n"))


def publish(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each message to the subscribers of its channel."""
    return messages.join(subscriptions, "channel").select("subscriber", "channel", "message")


def once(messages: DataFrame, by: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Redelivered messages are dropped while the watermark keeps their id."""
    return messages.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late).dropDuplicatesWithinWatermark([by])
