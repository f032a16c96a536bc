"""Cycles at even times: nearest insertion in two passes, filling and smoothing in between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import trajectory
from .cycles import around

#: Milliseconds of a trajectory that a smoothed point is fitted to.
REACH = 166.677


def anchors(durations: DataFrame) -> DataFrame:
    """``phases.cycle_durations``' cycles with ``anchor``: where their even times start. An open first cycle is anchored at its end, all others at their first frame.

    Cycles whose duration is unknown are dropped.
    """
    open_first = (F.col("cycle") == 0) & ~F.col("whole")
    return durations.where(F.col("duration") > 0).withColumn("anchor", F.when(open_first, F.col("end_t") - F.col("duration")).otherwise(F.col("start_t")))


def _nearest(t: Column, *more: str) -> list[Column]:
    """The gap, time and ``more`` of the frame before and of the one after; the earlier one is smaller where gaps are equal."""
    return [F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col(f"{s}.t") - t).alias("gap"), F.col(f"{s}.t").alias("t"), *[F.col(f"{s}.{c}").alias(c) for c in more])) for s in ("before", "after")]


def _pick(df: DataFrame, name: str, t: Column, *more: str) -> DataFrame:
    before, after = _nearest(t, *more)
    return df.withColumn(name, F.when(after["gap"] < before["gap"], after).otherwise(F.coalesce(before, after)))


def standardise(frames: DataFrame, cycles: DataFrame, by: list[str], t: str, values: str, label: str, length: int, tolerance: float, labels: int, reach: float = REACH, earliest: float = 0.0) -> DataFrame:
    """``by, cycle, nth, share, values, label``: every cycle at ``length`` even times from its anchor on, its duration over ``length`` apart.

    ``frames`` are ``phases.members``' rows with an array ``values`` (coordinates, null where missing) and an int ``label``; ``cycles`` are ``anchors``' rows.
    First pass, each asked time gets a copy of the nearest frame, by less than the ``tolerance``; copies count as frames for the times after them, so
    sparse frames are carried on. Then every coordinate of a cycle is filled between its known points and smoothed. Second pass, each asked time
    takes the nearest of all frames and copies, by less than twice the tolerance. ``share`` is where that one lies in the cycle (0 to 1).

    The first row of a cycle has label 1 and the last ``labels``. Asked times are whole millionths, so that predicted durations' last bits decide no tie. One without any frame has null values and label. Times before ``earliest`` are not asked for.
    """
    keys = [*by, "cycle"]
    cycles = cycles.repartition(*keys)  # rows are moved to their cycle once; asked times, copies and smoothed points are made where they are
    asked = cycles.select(*keys, "anchor", "duration", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("nth"))
    asked = asked.withColumn(t, F.round(F.col("anchor") + F.col("nth") * (F.col("duration") / F.lit(float(length))), 6)).where(F.col(t) >= earliest)
    known = frames.select(*keys, t, F.col(values).alias("values"), F.col(label).cast("int").alias("label")).repartition(*keys)

    near = _pick(around(asked, known, keys, t, ["values", "label"]), "m", F.col(t), "values", "label")
    line = Window.partitionBy(*keys).orderBy("nth")
    close = F.col("m.gap") < tolerance
    since = F.col(t) - F.lag(t).over(line)
    near = near.withColumn("since", since).withColumn("close", F.coalesce(close, F.lit(False)))
    near = near.withColumn("before_it", F.coalesce(F.max("close").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    carries = F.coalesce(F.col("since") < tolerance, F.lit(True))  # is the copy before it near enough to be copied again
    own = F.col("close") & (~F.col("before_it") | ~carries | (F.col("m.gap") <= F.col("since")))
    near = near.withColumn("copy", F.when(own, F.struct("m.values", "m.label")))
    held = F.last("copy", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    copies = near.withColumn("copy", F.when(carries, held).otherwise(F.col("copy"))).where("copy IS NOT NULL").select(*keys, t, "copy.values", "copy.label")

    every = known.join(cycles.select(*keys), keys).unionByName(copies)
    each = every.select(*keys, t, F.posexplode("values").alias("axis", "v"))
    filled = trajectory.fill_gaps(each, [*keys, "axis"], t, "v").withColumn("v", F.col("filled")).drop("filled")
    smooth = trajectory.smooth_reach(filled, [*keys, "axis"], t, "v", reach).select(*keys, F.col("t").alias(t), F.struct("axis", F.col("smooth").alias("v")).alias("p")).repartition(*keys)
    each = every.select(*keys, t, "label", F.size("values").alias("n")).unionByName(smooth, allowMissingColumns=True)
    each = each.groupBy(*keys, t, "p.axis").agg(F.min("label").alias("label"), F.max("n").alias("n"), F.min("p.v").alias("v"))
    named = each.groupBy(*keys, t).agg(F.min("label").alias("label"), F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.when(F.col("axis").isNotNull(), F.struct("axis", "v")))).alias("at"))
    named = named.select(*keys, t, "label", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.try_element_at("at", i)).alias("values"))

    picked = _pick(around(asked, named, keys, t, ["values", "label"]), "m", F.col(t), "values", "label")
    picked = picked.withColumn("m", F.when(F.col("m.gap") < 2 * tolerance, F.col("m")))
    share = F.coalesce(F.greatest((F.col("m.t") - F.col("anchor")) / F.col("duration"), F.lit(0.0)), (F.col(t) - F.col("anchor")) / F.col("duration"))
    rows = picked.withColumn("share", share).where(F.col("share") <= 1.0)
    ends = Window.partitionBy(*keys)
    rows = rows.withColumns({"_a": F.min("nth").over(ends), "_b": F.max("nth").over(ends)})
    named_ends = F.when((F.col("_a") < F.col("_b")) & (F.col("nth") == F.col("_a")), 1).when((F.col("_a") < F.col("_b")) & (F.col("nth") == F.col("_b")), labels).otherwise(F.col("m.label"))
    return rows.select(*keys, "nth", "share", F.col("m.values").alias("values"), named_ends.alias("label"))
