"""The streaming jobs. The same transformations run on batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_throughput(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events, completions and revenue per manager and day; on a stream, rows later than `late` are dropped."""
    if events.isStreaming:
        events = events.withWatermark("at", late)
    return events.groupBy("manager_id", F.window("at", "1 day").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("kind") == "done").cast("long")).alias("done"), F.sum("amount").alias("revenue"))


def weekly_throughput(events: DataFrame, late: str = "2 days") -> DataFrame:
    """The same over weeks that slide by a day."""
    if events.isStreaming:
        events = events.withWatermark("at", late)
    return events.groupBy("manager_id", F.window("at", "7 days", "1 day").alias("week")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("kind") == "done").cast("long")).alias("done"))


def live_negatives(feedback: DataFrame, late: str = "2 days") -> DataFrame:
    """Dismissals without repeats of the same event within the watermark; readers filter by age."""
    dismissed = feedback.where("kind = 'dismissed'").select("event_id", "task_key", "at")
    return dismissed.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"]) if dismissed.isStreaming else dismissed.dropDuplicates(["event_id"])
