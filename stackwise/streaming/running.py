"""Extension: running estimates over streams of events.  Nothing here is needed for the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, directory: str, schema) -> DataFrame:
    """New Parquet files of a directory as a stream of events with a watermarkable time."""
    return spark.readStream.schema(schema).parquet(directory).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_mean(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, sum and mean of each type and window; also for batches, where the watermark has no effect."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total", "mean")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n", "total")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all there is and stop; restarts go on from the checkpoint."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
