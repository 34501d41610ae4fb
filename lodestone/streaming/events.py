"""Streams over event tables: windows with watermarks, deduplication, static joins and stateful folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema_of: DataFrame, per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; times without zone become timestamps, which watermarks need."""
    reader = spark.readStream.schema(schema_of.schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Counts by window and type; rows later than the watermark are left out, finished windows are appended."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


def without_repeats(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def with_dimension(events: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """A stream joined with a static table."""
    return events.join(dimension, key, "left")


def run_to_memory(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there and returns its result table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
