"""Extensions beyond the reference: event-time windows over streams, and a live work queue.

All take batch or streaming DataFrames alike; on a stream the watermark bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, most_files: int = 16) -> DataFrame:
    """A stream of Parquet event files; watermarks need ``ts`` with a time zone, the session's if it has none."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and value sums by event type and window, tumbling or with ``slide`` sliding."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each user that end after ``gap`` without an event."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Process what there is, then stop; the checkpoint makes a later run go on from here."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
