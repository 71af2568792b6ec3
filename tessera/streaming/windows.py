"""Windowed aggregates over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path


def source(spark: SparkSession, path: str) -> DataFrame:
    """A folder or file of events as a stream; a single file is named by a pattern only it matches."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path[:-1] + "[" + path[-1] + "]")


def counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events of each type per window; rows later than the watermark are left out."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stamped.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A user's events with no longer gap than ``gap``, as sessions."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def hourly_counts(spark: SparkSession, path: str) -> DataFrame:
    """Drain the stream once and return what it counted."""
    out = scratch_path(spark, "hourly")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(out)

    query = counts(source(spark, path)).writeStream.outputMode("complete").foreachBatch(keep)
    query.option("checkpointLocation", scratch_path(spark, "hourly-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
