"""Structured Streaming over event logs: status changes by keyed state, late data by watermarks, and sessions.

The archive that these operators come from polls a table; the windowed aggregates here go beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    reader = spark.readStream.schema(EVENTS)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Counts and sums by type in tumbling or sliding windows; rows later than the watermark are left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events less than a gap apart."""
    s = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy(s, "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def status_transitions(events: DataFrame) -> DataFrame:
    """A notification for each change of a user's status; the last status of each user is the state.

    Events of a micro-batch are taken in the order of (time, id).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        before = rows.event_type.shift(1)
        before.iloc[0] = last
        state.update((rows.event_type.iloc[-1],))
        changed = rows[before.fillna("") != rows.event_type]
        yield pd.DataFrame({"user_id": key[0], "event_id": changed.event_id, "previous": before[changed.index], "status": changed.event_type})

    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, previous string, status string", "last string", "append", GroupStateTimeout.NoTimeout
    )
