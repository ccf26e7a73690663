"""Streams of job events: windows with watermarks, and the job state machine as a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.jobs import TERMINAL


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by type in tumbling windows of event time (an extension). events: ts, event_type, value."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each user by a gap in event time (an extension). events: ts, user_id."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def job_states(events: DataFrame) -> DataFrame:
    """Status changes of each job as events arrive: job_id, status, events. events: job_id, seq, status. Terminal states are left by nothing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, n = state.get if state.exists else ("", 0)
        for batch in batches:
            for s in batch.sort_values("seq")["status"]:
                n += 1
                if status not in TERMINAL:
                    status = s
        state.update((status, n))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "events": [n]})

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id long, status string, events long", "status string, n long", "update", "NoTimeout")


def retain(rows: DataFrame, column: str, days: int) -> DataFrame:
    """Drops rows older than ``days`` before now; run it on a trigger as the retention job."""
    return rows.filter(F.col(column) >= F.current_timestamp() - F.make_dt_interval(F.lit(days)))
