"""Windowed counts over the event stream; the same plan runs on a table and on a stream.

An extension: batch retrieval needs no stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """(hour, event_type, events, total) by tumbling hours; on a stream, events later than ``lateness`` are dropped."""
    rows = events.where(F.col("ts").isNotNull())
    if events.isStreaming:
        rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    grouped = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "events", "total")


def read_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
