"""Event streams: the same transformations on batch and streaming DataFrames of events(ts, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive under a path."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total by hour; on a stream, what comes later than the watermark is left out."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    by = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start, n of runs of a user's events without a longer gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    by = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return by.select("user_id", F.col("w.start").alias("start"), "n")


def once(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events without repeats of an event_id; on a stream within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def write(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is final as Parquet; runs through what there is and ends."""
    return rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
