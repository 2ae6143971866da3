"""Streams of result rows: dedup by id and running summaries. An extra of this engine; the surveyed workload has none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, glob: str = "events*.parquet") -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once; state older than the watermark goes."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """All that is there now, appended to a table in the shared folder beside the stream's checkpoint, and read back."""
    spark = stream.sparkSession
    path = scratch.new_path(spark, name)
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
