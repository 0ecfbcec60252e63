"""Structured Streaming forms of the incremental operators: same results as the batch ones over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stream of the event files that arrive under `path`; ts becomes a timestamp."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_counts(events: DataFrame, late: str = "30 days") -> DataFrame:
    """Events per hour and type, with a watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def once_per_id(events: DataFrame, late: str = "30 days") -> DataFrame:
    """Each event_id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_available(df: DataFrame, checkpoint: str, out: str, mode: str = "append") -> None:
    """Process what has arrived and stop; written as parquet, exactly once per checkpoint."""
    df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(out).awaitTermination()


def run_to_table(df: DataFrame, name: str, checkpoint: str) -> None:
    """Process what has arrived into an in-memory table of complete results."""
    df.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
