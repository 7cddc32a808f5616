"""Structured Streaming forms of the monthly buckets, late evidence and the append-only log.

Each equals its batch form once the watermark has passed; tests compare both.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worksight.functions.scalar import add_working_days


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums per event type and window of event time; later rows than `late` are dropped."""
    w = F.window("ts", every)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Sessions of a user: runs of events less than `gap` apart."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("start"), "events")


def late_evidence(captures: DataFrame, days: int = 3) -> DataFrame:
    """captures (captured_on, due_month) with late: after the month's nth working day. Nothing is dropped."""
    due = add_working_days(F.date_sub(F.trunc("due_month", "MM"), 1), days)
    return captures.withColumn("late", F.col("captured_on") > due)


def latest_status(log: DataFrame) -> DataFrame:
    """Per user the status of the last record seen and how many there were, updated as rows come."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, status, n = state.get if state.exists else (pd.Timestamp.min.value, None, 0)
        for rows in batches:
            n += len(rows)
            last = rows.sort_values(["ts", "event_id"]).iloc[-1]
            if last.ts.value >= at:
                at, status = last.ts.value, last.event_type
        state.update((at, status, n))
        yield pd.DataFrame({"user_id": [key[0]], "status": [status], "records": [n]})

    return log.groupBy("user_id").applyInPandasWithState(update, "user_id long, status string, records long", "at long, status string, n long", "update", "NoTimeout")
