"""Event streams: windowed counts with late data, and a drift guard per batch. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import drift


def read_events(spark: SparkSession, path: str, files_a_trigger: int = 16) -> DataFrame:
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """n and total value by window and type; works on a stream or a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    counts = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def guarded(counts: DataFrame, before: DataFrame, most: float = 0.2) -> DataFrame:
    """Counts of a batch against earlier ones, by type, marked by drift()."""
    return drift(counts.join(before, "event_type", "left"), most)
