"""Samples of phases: what a frame sees half a cycle back and ahead, with time stretched to the cycles it reaches into.

A recording is cut into cycles at its start events. Its first and last cycle may be open; their duration is predicted from those of the whole ones.
A time that falls before or after its frame's cycle lies in the cycle next to it, as many shares of that one's duration away from
the border as it is shares of its own.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cycles import around

#: What stands for a feature that cannot be had, by the order of its pair's instants.
MASK = 2.0 / 100.0
_PAST = (Window.unboundedPreceding, Window.currentRow)


def own_cycles(frames: DataFrame, by: list[str], t: str, mark: str, start: int = 1) -> DataFrame:
    """``frames`` with ``cycle`` (from 0) and ``splits``: a cycle reaches from one start event's frame to the next one's, both included.

    A frame on a border belongs to the earlier cycle (its ``splits`` says that it opens one as well). Frames before the first start event are an open
    cycle, frames after the last one another. Start events that follow one another directly open one cycle. Recordings with fewer than two are dropped.
    """
    order = Window.partitionBy(*by).orderBy(t)
    at_start = F.coalesce(F.col(mark) == start, F.lit(False))
    marked = frames.withColumn("_start", at_start).withColumn("splits", F.col("_start") & ~F.coalesce(F.lag("_start").over(order), F.lit(False))).drop("_start")
    passed = F.coalesce(F.sum(F.col("splits").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.first(F.col("splits").cast("int")).over(order.rowsBetween(*_PAST))
    numbered = marked.withColumn("cycle", F.greatest(passed - first, F.lit(0)).cast("int"))
    return numbered.withColumn("_n", F.sum(F.col("splits").cast("int")).over(Window.partitionBy(*by))).where("_n > 1").drop("_n")


def members(owned: DataFrame, by: list[str], t: str) -> DataFrame:
    """``own_cycles``' rows by ``cycle``, those on a border between two cycles in both."""
    all_of = Window.partitionBy(*by)
    inner = (F.col(t) > F.min(t).over(all_of)) & (F.col(t) < F.max(t).over(all_of))
    both = owned.withColumn("_both", F.col("splits") & inner)
    return both.withColumn("cycle", F.explode(F.when(F.col("_both"), F.array(F.col("cycle"), F.col("cycle") + 1)).otherwise(F.array("cycle")))).drop("_both")


def cycle_durations(owned: DataFrame, by: list[str], t: str, axes: list[str], least: float) -> DataFrame:
    """``by, cycle, start_t, end_t, whole, duration, prev_duration, next_duration, first_t, last_t`` of ``own_cycles``' frames.

    An open cycle's duration is its velocity times the mean duration per velocity of the whole cycles that last longer than ``least``; without a
    velocity, or where no whole cycle moves, their mean duration. A cycle's velocity is the distance of its first and last known point, of ``axes``, over time.
    """
    point = F.when(reduce(and_, [F.col(a).isNotNull() for a in axes]), F.struct(F.col(t).alias("t"), *axes))
    member = members(owned, by, t).select(*by, F.col(t).alias("t"), "cycle", "splits", point.alias("p"))
    facts = member.groupBy(*by, "cycle").agg(F.min(F.struct("t", "splits")).alias("a"), F.max(F.struct("t", "splits")).alias("b"), F.min("p").alias("p"), F.max("p").alias("q"))
    far = F.sqrt(sum((F.col(f"q.{x}") - F.col(f"p.{x}")) * (F.col(f"q.{x}") - F.col(f"p.{x}")) for x in axes))
    facts = facts.select(*by, "cycle", F.col("a.t").alias("start_t"), F.col("b.t").alias("end_t"), (F.col("a.splits") & F.col("b.splits")).alias("whole"), (far / F.nullif(F.col("q.t") - F.col("p.t"), F.lit(0.0))).alias("velocity"))
    length = F.col("end_t") - F.col("start_t")
    known = F.col("whole") & (length > least) & F.col("velocity").isNotNull()
    every, line = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("cycle")
    facts = facts.withColumn("ratio", F.avg(F.when(known & (F.col("velocity") > 0), length / F.col("velocity"))).over(every)).withColumn("mean", F.avg(F.when(known, length)).over(every))
    facts = facts.withColumn("duration", F.when(F.col("whole"), length).otherwise(F.coalesce(F.col("velocity") * F.col("ratio"), F.col("mean"))))
    return facts.select(
        *by, "cycle", "start_t", "end_t", "whole", "duration", F.lag("duration").over(line).alias("prev_duration"), F.lead("duration").over(line).alias("next_duration"),
        F.min("start_t").over(every).alias("first_t"), F.max("end_t").over(every).alias("last_t"),
    )


def warped(t: Column) -> Column:
    """A time of a frame's own cycle, moved to where the neighbouring cycle has it when it lies outside; cycles without a neighbour go on."""
    before = F.col("start_t") - (F.col("start_t") - t) / F.col("duration") * F.col("prev_duration")
    after = F.col("end_t") + (t - F.col("end_t")) / F.col("duration") * F.col("next_duration")
    return F.when((t < F.col("start_t")) & F.col("prev_duration").isNotNull(), before).when((t > F.col("end_t")) & F.col("next_duration").isNotNull(), after).otherwise(t)


def phase_windows(owned: DataFrame, durations: DataFrame, by: list[str], t: str, tolerance: float, width: float) -> DataFrame:
    """``owned`` with its cycle's facts and ``window_start, window_end``: the frames from half a cycle back to half a cycle ahead.

    Each end is the frame closest to the warped time; one beyond it must be within the ``tolerance``, one inside may be any. A recording that
    ends earlier bounds the window itself; a frame with neither end inside the recording has no window and is dropped.
    """
    facts = owned.join(durations, [*by, "cycle"])
    half = F.col("duration") * F.lit(0.5)
    facts = facts.withColumn("_left", warped(F.col(t) - half)).withColumn("_right", warped(F.col(t) + half))
    facts = facts.withColumn("_has_left", F.col("first_t") <= F.col("_left")).withColumn("_has_right", F.col("last_t") >= F.col("_right")).where("_has_left OR _has_right")
    frames = owned.select(*by, t)

    def ended(rows: DataFrame, at: str, name: str, inward: str, outward: str, end: str, has: str) -> DataFrame:
        """The frame nearest to ``at``: ties go to the earlier one."""
        near = around(rows.withColumn("_t", F.col(t)).withColumn(t, F.col(at)), frames, by, t, [], width)
        gap = lambda s: F.abs(F.col(f"{s}.t") - F.col(at))
        outer = F.when(gap(outward) < tolerance, F.struct(gap(outward).alias("gap"), F.col(f"{outward}.t").alias("t")))
        inner = F.when(F.col(inward).isNotNull(), F.struct(gap(inward).alias("gap"), F.col(f"{inward}.t").alias("t")))
        return near.withColumn(t, F.col("_t")).withColumn(name, F.when(F.col(has), F.least(outer, inner)["t"]).otherwise(F.col(end))).drop("_t", "before", "after")

    facts = ended(facts, "_left", "window_start", "before", "after", "first_t", "_has_left")
    facts = ended(facts, "_right", "window_end", "after", "before", "last_t", "_has_right")
    return facts.drop("_left", "_right", "_has_left", "_has_right")


def phase_samples(windows: DataFrame, frames: DataFrame, by: list[str], key: list[str], t: str, values: str, pairs: list[tuple[int, float, float]], tolerance: float, width: float) -> DataFrame:
    """``windows`` with ``features``: for each of ``pairs`` (channel, u, v) the channel's value u shares of a cycle from the frame less that at v shares.

    ``key`` tells the rows of ``windows`` apart; ``frames`` has the array ``values`` of channels at its times. An instant is the frame of the window closest to the warped time (ties to the
    earlier), if within the ``tolerance``. A feature whose instants or values are missing is the mask, negative where u comes before v. Rows
    without any real feature are dropped. Frames are asked for once per distinct share, however many pairs and channels use it.
    """
    shares = sorted({s for _, u, v in pairs for s in (u, v)})
    asked = windows.select(*by, *key, "window_start", "window_end", F.col(t).alias("_own"), "start_t", "end_t", "duration", "prev_duration", "next_duration", F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("_share", "_u"))
    at = warped(F.col("_own") + F.col("_u") * F.col("duration"))
    asked = asked.withColumn("_at", at).withColumn(t, F.least(F.greatest(F.col("_at"), F.col("window_start")), F.col("window_end")))
    asked = asked.select(*by, *key, "_share", "_at", "window_start", "window_end", t)
    found = around(asked, frames.select(*by, t, F.col(values).alias("_values")), by, t, ["_values"], width)
    near = [F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col(f"{s}.t") - F.col(t)).alias("gap"), F.col(f"{s}.t").alias("t"), F.col(f"{s}._values").alias("values"))) for s in ("before", "after")]
    best = found.withColumn("_m", F.when(near[1]["gap"] < near[0]["gap"], near[1]).otherwise(F.coalesce(*near)))
    close = best.where(F.abs(F.col("_m.t") - F.col("_at")) <= tolerance)
    seen = close.groupBy(*by, *key).agg(F.map_from_entries(F.collect_list(F.struct("_share", "_m.values"))).alias("_seen"))  # as many as there are shares
    index = {s: i for i, s in enumerate(shares)}
    value = lambda channel, s: F.get(F.try_element_at("_seen", F.lit(index[s])), F.lit(channel))
    features = [value(c, u) - value(c, v) for c, u, v in pairs]
    masks = [F.lit(-MASK if u < v else MASK) for _, u, v in pairs]
    rows = windows.join(seen, [*by, *key])
    return rows.where(reduce(or_, [f.isNotNull() for f in features])).select(*windows.columns, F.array(*[F.coalesce(f, m) for f, m in zip(features, masks)]).alias("features"))
