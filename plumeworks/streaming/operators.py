"""Streaming forms: daily buckets, sliding windows, sessions, deduplication.

Event time must be a timestamp with time zone; `event_time` casts what arrives
without one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, per_trigger: int = 1000) -> DataFrame:
    """A stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def event_time(stream: DataFrame, column: str, late: str) -> DataFrame:
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def daily_buckets(stream: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Counts and sums by day."""
    rows = event_time(stream, at, late)
    return rows.groupBy(F.window(at, "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.to_date("w.start").alias("day"), "n", "total")


def sliding_counts(stream: DataFrame, width: str = "14 days", slide: str = "1 day", at: str = "ts", late: str = "1 day") -> DataFrame:
    rows = event_time(stream, at, late)
    return rows.groupBy(F.window(at, width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("start_day"), "n")


def sessions(stream: DataFrame, key: str, gap: str, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Activity of a key without a pause longer than the gap."""
    rows = event_time(stream, at, late)
    return rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n")


def dedup(stream: DataFrame, keys: list[str], at: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return event_time(stream, at, late).dropDuplicatesWithinWatermark(keys)
