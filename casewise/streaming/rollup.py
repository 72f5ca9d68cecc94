"""The daily rollup as a stream: an extension, with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import micros


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts and revenue of each entity and day; events later than ``late`` are left out, state is dropped behind the watermark."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    is_kind = lambda k: F.sum(F.when(F.col("event_type") == k, 1).otherwise(0))
    return (
        stamped.groupBy(F.window("at", "1 day").alias("w"), "user_id")
        .agg(is_kind("view").alias("impressions"), is_kind("click").alias("clicks"), is_kind("purchase").alias("conversions"), F.sum(F.when(F.col("event_type") == "purchase", micros(F.col("value"))).otherwise(0)).alias("revenue_micros"))
        .select(F.to_date("w.start").alias("day"), "user_id", "impressions", "clicks", "conversions", (F.col("revenue_micros") / 10000).alias("revenue"))
    )


def run_to_table(counts: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, append finished days, and stop."""
    counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
