"""Event-time forms of the timeline operators for Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need a timestamp with time zone; one without is read in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def window_facts(events: DataFrame, late: str = "10 minutes", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """``start, end, event_type, n, mean``: counts and mean values in event-time windows; rows later than ``late`` are dropped."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = _timed(events).withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """``user_id, start, end, n``: runs of a user's events with no pause longer than ``gap``."""
    grouped = _timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def cycles(events: DataFrame, start_event: str = "click") -> DataFrame:
    """``user_id, cycle, start_ms, events``: a user's finished cycles, each when the next start event arrives.

    The state of a user is the open cycle alone. Events are taken in time order within a micro-batch.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, begun, count, last_start = state.get if state.exists else (0, 0, 0, False)
        done = []
        for r in pd.concat(list(batches)).sort_values("ms").itertuples():
            opens = r.event_type == start_event
            if opens and not last_start:
                if number:
                    done.append((key[0], number, begun, count))
                number, begun, count = number + 1, r.ms, 0
            count, last_start = count + 1, opens
        state.update((number, int(begun), count, last_start))
        yield pd.DataFrame(done, columns=["user_id", "cycle", "start_ms", "events"])

    rows = events.select("user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, cycle int, start_ms long, events int", "number int, begun long, count int, last_start boolean", "append", GroupStateTimeout.NoTimeout)
