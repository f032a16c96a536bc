"""Stateful forms of gap filling and scoring for Structured Streaming.

Gap filling keeps state with timers, for which the session's state store must be RocksDB
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.split import Forest

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Filler(StatefulProcessor):
    """A sequence's rows that the watermark has not passed, those still missing a later known value, and its last known one."""

    def __init__(self, patience_ms: int | None):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, event_id long, v double")
        self.last = handle.getValueState("last", "ms long, v double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))
        new = [(int(r.ms), int(r.event_id), None if pd.isna(r.v) else float(r.v)) for r in arrived.itertuples()]
        self.waiting.appendList(new)
        for at in sorted({max(ms for ms, *_ in new), *([ms + self.patience for ms, _, v in new if v is None] if self.patience is not None else [])}):
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        last = tuple(self.last.get()) if self.last.exists() else None
        out, gap = [], []
        ripe = [r for r in rows if r[0] <= passed]
        for ms, event_id, v in ripe:
            if v is None:
                gap.append((ms, event_id, None))
                continue
            for at, missing, _ in gap:
                out.append((key[0], missing, at, None if last is None else last[1] + (v - last[1]) * ((at - last[0]) / (ms - last[0])) if ms > last[0] else last[1]))
            out.append((key[0], event_id, ms, v))
            gap, last = [], (ms, v)
        if self.patience is not None:
            out += [(key[0], event_id, ms, None) for ms, event_id, _ in gap if passed >= ms + self.patience]
            gap = [r for r in gap if passed < r[0] + self.patience]
        left = gap + rows[len(ripe) :]
        self.waiting.clear()
        if left:
            self.waiting.put(left)
        if last is not None:
            self.last.update(last)
        yield pd.DataFrame(out, columns=["seq_id", "event_id", "ms", "filled"])


def fill_gaps(events: DataFrame, late: str = "1 hour", patience_ms: int | None = None) -> DataFrame:
    """``seq_id, event_id, ms, filled`` of a stream ``seq_id, event_id, ts, v``: missing values on the line between their neighbours in time.

    Rows may come out of order, by less than ``late``. A row is given when the watermark has passed it; a missing one when it has passed the next known one
    too, or after ``patience_ms`` without one (then null, as are those before the first known value). The state of a sequence is what the
    watermark has not passed, its open gap and one known value.
    """
    timed = events.select("seq_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "v").withWatermark("ts", late)
    rows = timed.withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("seq_id").transformWithStateInPandas(_Filler(patience_ms), "seq_id long, event_id long, ms long, filled double", "append", "eventTime")


def score(samples: DataFrame, key: list[str], features: str, forest: Forest) -> DataFrame:
    """``Forest.predict`` on a stream of samples; without state, so it scales with the stream. The forest must be small enough to be sent to every task."""
    if forest.nodes.count() > forest.MOST:
        raise ValueError(f"a stream is scored by forests of at most {forest.MOST} nodes")
    return forest.predict(samples, key, features)
