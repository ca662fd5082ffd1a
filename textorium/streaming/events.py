"""Streaming twins of the batch rollups and of the idempotent top-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, folder: str, schema: str = EVENTS, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed_counts(events: DataFrame, every: str = "7 days", late: str = "1 day") -> DataFrame:
    """(start, theme, n, mean) per window and theme; later events than the watermark are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), F.col("event_type").alias("theme"))
    return w.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "theme", "n", "mean")


def first_seen(rows: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Rows whose key hasn't come within the watermark: the frontier of a crawl as a stream."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
