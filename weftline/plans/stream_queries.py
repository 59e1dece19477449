"""Streams over the events table, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.streaming import streams


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    stream = streams.file_stream(spark, f"{sf_dir}/events.parq*", spark.read.parquet(path))
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and types as first seen within a watermark longer than the table."""
    seen = streams.first_seen(_events(spark, sf_dir), ["user_id", "event_type"], "ts", "3650 days")
    return streams.run_to_table(seen.select("user_id", "event_type"), "first-seen")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by type; windows that the watermark has not closed at the end are not out yet."""
    out = streams.window_counts(_events(spark, sf_dir), "ts", ["event_type"], "1 day", "1 day")
    return streams.run_to_table(out, "windows").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.col("total").cast("double").alias("total"))


QUERIES = {"stream_first_seen": stream_first_seen, "stream_windows": stream_windows}
ORACLES = {
    "stream_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2",
}
