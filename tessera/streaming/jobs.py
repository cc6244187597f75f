"""Job streams: deduplication within a watermark, daily usage and idempotent upserts.

These are additions for continuous ingestion; batch equivalents are in the plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """The event files as a stream; timestamps without zone become UTC instants.

    ``path`` may be a pattern, as it must be where the table is a single file.
    """
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def distinct_jobs(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each job once, as long as repetitions come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def daily_usage(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Usage of each user by day; a day is emitted when the watermark has passed it."""
    per = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "user_id")
    return per.agg(F.sum("value").alias("n_tokens"), F.count(F.lit(1)).alias("n_jobs")).select(F.col("w.start").alias("day"), "user_id", "n_tokens", "n_jobs")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; a second run continues from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Give each micro-batch and its number to ``write``, which must be idempotent by number."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
