"""Events on the time axis: nearest and interval joins, phases, cycles and what is computed of cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PAST = (Window.unboundedPreceding, Window.currentRow)


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], t: str, left_id: str, right_id: str, tolerance: float | None = None, fuzzy: str | None = None) -> DataFrame:
    """``by, left_id, right_id, gap``: each left row's nearest right row in time, ties to the earlier time, then the smaller id.

    Both sides are laid on one time axis and the last right row before and the first after each left row are windows over it, so the
    cost is one sort, not a product. With ``tolerance`` a farther match is none (null). ``fuzzy`` bounds one side only: ``left`` takes
    any match before and one after within the tolerance, ``right`` any match after and one before within it.
    """
    a = left.select(*by, F.col(t).alias("t"), F.col(left_id).alias("lid"), F.lit(None).cast("long").alias("rid"))
    b = right.select(*by, F.col(t).alias("t"), F.lit(None).cast("long").alias("lid"), F.col(right_id).alias("rid"))
    axis = a.unionByName(b)
    here = F.when(F.col("rid").isNotNull(), F.struct(F.col("t").alias("t"), (-F.col("rid")).alias("n")))
    past = Window.partitionBy(*by).orderBy("t", F.col("rid").isNull()).rowsBetween(*_PAST)
    ahead = Window.partitionBy(*by).orderBy(F.desc("t"), F.col("rid").isNull()).rowsBetween(*_PAST)
    near = axis.withColumn("p", F.max(here).over(past)).withColumn("q", F.min(F.when(F.col("rid").isNotNull(), F.struct(F.col("t").alias("t"), F.col("rid").alias("n")))).over(ahead))
    before = F.when(F.col("p").isNotNull(), F.struct((F.col("t") - F.col("p.t")).alias("gap"), F.col("p.t").alias("at"), (-F.col("p.n")).alias("id")))
    after = F.when(F.col("q").isNotNull(), F.struct((F.col("q.t") - F.col("t")).alias("gap"), F.col("q.t").alias("at"), F.col("q.n").alias("id")))
    if fuzzy == "left":
        after = F.when(after["gap"] < tolerance, after)
    elif fuzzy == "right":
        before = F.when(before["gap"] < tolerance, before)
    best = F.least(before, after)
    if tolerance is not None and fuzzy is None:
        best = F.when(best["gap"] <= tolerance, best)
    return near.where(F.col("lid").isNotNull()).withColumn("m", best).select(*by, F.col("lid").alias(left_id), F.col("m.id").alias(right_id), F.col("m.gap").alias("gap"))


def around(asked: DataFrame, frames: DataFrame, by: list[str], t: str, carry: list[str], width: float | None = None) -> DataFrame:
    """``asked`` with ``before`` and ``after``: structs of ``t`` and ``carry`` of the last frame not after and the first not before each asked time.

    Time is cut into buckets of ``width``. Windows look inside a bucket, and what lies beyond it is carried over from the neighbouring
    buckets that have frames, so that no task sorts a whole sequence. Without a ``width`` a sequence is one bucket and nothing is carried. Of frames at
    one time the one with the greatest ``carry`` counts.
    A null time has no neighbours.
    """
    here = F.struct(F.col(t).alias("t"), *carry)
    kind = frames.select(here.alias("f")).schema["f"].dataType
    axis = asked.withColumns({"_f": F.lit(None).cast(kind), "_asked": F.lit(True)}).unionByName(frames.select(*by, t, here.alias("_f"), F.lit(False).alias("_asked")), allowMissingColumns=True)
    if width is None:
        up, down = [Window.partitionBy(*by).orderBy(o, "_asked", "_f").rowsBetween(*_PAST) for o in (F.asc(t), F.desc(t))]
        sides = {"before": F.last("_f", ignorenulls=True).over(up), "after": F.last("_f", ignorenulls=True).over(down)}
        near = axis.withColumns({c: F.when(F.col(t).isNotNull(), side) for c, side in sides.items()}).where("_asked")
        return near.select(*asked.columns, "before", "after")
    axis = axis.withColumn("_b", F.floor(F.col(t) / F.lit(float(width))))
    ends = axis.groupBy(*by, "_b").agg(F.max_by("_f", F.when(F.col("_f").isNotNull(), F.struct(-F.col(t), F.col("_f")))).alias("_lo"), F.max("_f").alias("_hi"))
    past, ahead = [Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_b"), F.desc("_b"))]
    ends = ends.select(*by, "_b", F.last("_hi", ignorenulls=True).over(past).alias("_earlier"), F.last("_lo", ignorenulls=True).over(ahead).alias("_later"))
    up, down = [Window.partitionBy(*by, "_b").orderBy(o, "_asked", "_f").rowsBetween(*_PAST) for o in (F.asc(t), F.desc(t))]
    near = axis.withColumns({"_p": F.last("_f", ignorenulls=True).over(up), "_q": F.last("_f", ignorenulls=True).over(down)}).where("_asked").join(ends, [*by, "_b"], "left")
    return near.select(*asked.columns, F.coalesce("_p", "_earlier").alias("before"), F.coalesce("_q", "_later").alias("after"))


def phase(previous: Column, current: Column, phases: int) -> Column:
    """The phase between two consecutive events: ``previous`` if ``current`` is the next one in the cycle, else null."""
    return F.when(current == previous % phases + 1, previous)


def interval_phase(marks: DataFrame, frames: DataFrame, by: list[str], phases: int) -> DataFrame:
    """``frames`` with ``phase``: that of the interval [event, next event) a frame lies in, by carrying the latest event forward.

    ``marks``: ``by, t, mark``; ``frames``: ``by, t`` and more. Of marks at one time the largest mark counts last.
    """
    order = Window.partitionBy(*by).orderBy("t", "mark")
    spans = marks.select(*by, "t", "mark").withColumn("next", F.lead("mark").over(order))
    events = spans.select(*by, "t", F.struct(phase(F.col("mark"), F.col("next"), phases).alias("phase")).alias("_span"), F.col("mark").alias("_mark"), F.lit(0).alias("_frame"))
    rest = [c for c in frames.columns if c not in (*by, "t")]
    axis = events.withColumns({c: F.lit(None).cast(frames.schema[c].dataType) for c in rest}).unionByName(frames.withColumns({"_span": F.lit(None).cast("struct<phase:int>"), "_mark": F.lit(None).cast("int"), "_frame": F.lit(1)}))
    latest = Window.partitionBy(*by).orderBy("t", "_frame", "_mark").rowsBetween(*_PAST)
    carried = axis.withColumn("_span", F.last("_span", ignorenulls=True).over(latest)).where(F.col("_frame") == 1)
    return carried.select(*frames.columns, F.col("_span.phase").alias("phase"))


def segment_cycles(df: DataFrame, by: list[str], t: str, mark: str, start: int = 1) -> DataFrame:
    """``cycle``: 0 before the first start event, then counting them; start events that follow one another directly open one cycle."""
    order = Window.partitionBy(*by).orderBy(t)
    opens = (F.col(mark) == start) & ~F.coalesce(F.lag(mark).over(order) == start, F.lit(False))
    return df.withColumn("_open", opens.cast("int")).withColumn("cycle", F.sum("_open").over(order.rowsBetween(*_PAST)).cast("int")).drop("_open")


def range_owner(frames: DataFrame, ranges: DataFrame, by: list[str], t: str, start: str, end: str, owner: str, width: float) -> DataFrame:
    """``frames`` with the smallest ``owner`` whose closed range holds the frame; frames without one are dropped.

    A range is posted to the one or two time buckets it touches, of the smallest width, ``width`` times a power of two, that is as long as it is; frames
    are posted to their bucket of each width that occurs. So the join is on equal buckets and a filter, and a long range is two rows like a short one.
    """
    long = F.greatest((F.col(end) - F.col(start)) / F.lit(width), F.lit(1.0))
    sized = ranges.where(F.col(end) >= F.col(start)).select(*by, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(owner).alias("_o"), F.ceil(F.log2(long)).cast("int").alias("_k"))
    bucket = lambda c: F.floor(c / (F.lit(width) * F.pow(F.lit(2.0), F.col("_k")))).cast("long")
    posted = sized.withColumn("_b", F.explode(F.sequence(bucket(F.col("_s")), bucket(F.col("_e")))))
    levels = sorted(r["_k"] for r in sized.select("_k").distinct().collect())  # at most as many as a double's exponents
    held = frames.withColumn("_k", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("_b", bucket(F.col(t)))
    held = held.join(posted, [*by, "_k", "_b"]).where((F.col(t) >= F.col("_s")) & (F.col(t) <= F.col("_e")))
    return held.groupBy(*frames.columns).agg(F.min("_o").alias(owner))


def cycle_facts(cycles: DataFrame, by: list[str], t: str, v: str) -> DataFrame:
    """Per cycle: ``frames, valid, start_t, end_t, duration, velocity`` (distance between its first and last valid values over their time)."""
    known = F.when(F.col(v).isNotNull(), F.struct(F.col(t).alias("t"), F.col(v).alias("v")))
    facts = cycles.groupBy(*by, "cycle").agg(F.count("*").alias("frames"), F.count(v).alias("valid"), F.min(t).alias("start_t"), F.max(t).alias("end_t"), F.min(known).alias("a"), F.max(known).alias("b"))
    speed = F.abs(F.col("b.v") - F.col("a.v")) / F.nullif(F.col("b.t") - F.col("a.t"), F.lit(0.0))
    return facts.select(*by, "cycle", "frames", "valid", "start_t", "end_t", (F.col("end_t") - F.col("start_t")).alias("duration"), speed.alias("velocity"))


def complete_cycles(facts: DataFrame, least_duration: float = 0.0) -> DataFrame:
    """Cycles all of whose frames are valid and that last longer than ``least_duration``."""
    return facts.where((F.col("cycle") > 0) & (F.col("frames") == F.col("valid")) & (F.col("duration") > least_duration))


def predict_duration(facts: DataFrame, by: list[str]) -> DataFrame:
    """``by, cycles, ratio, predicted``: the mean duration per velocity, and the duration it gives at the mean velocity."""
    usable = facts.where((F.col("velocity") > 0) & (F.col("cycle") > 0))
    means = usable.groupBy(*by).agg(F.count("*").alias("cycles"), F.avg(F.col("duration") / F.col("velocity")).alias("ratio"), F.avg("velocity").alias("mean_velocity"))
    return means.select(*by, "cycles", "ratio", (F.col("ratio") * F.col("mean_velocity")).alias("predicted"))


def in_window(rows: DataFrame, t: str, start: str, duration: str) -> DataFrame:
    """``rows`` from the start to the end of their window, with ``share``: how much of it has passed (0 to 1)."""
    since = F.col(t) - F.col(start)
    return rows.where((since >= 0) & (since <= F.col(duration))).withColumn("share", since / F.nullif(F.col(duration), F.lit(0.0)))


def path_velocity(points: DataFrame, by: list[str], t: str, axes: list[str]) -> DataFrame:
    """``by, velocity``: the distance of the first and last point that are not missing, over the time between them; null without two."""
    there = F.when(~F.greatest(*[F.col(a).isNull().cast("int") for a in axes]).cast("boolean"), F.struct(F.col(t).alias("t"), *axes))
    ends = points.groupBy(*by).agg(F.min(there).alias("a"), F.max(there).alias("b"))
    far = F.sqrt(sum((F.col(f"b.{x}") - F.col(f"a.{x}")) * (F.col(f"b.{x}") - F.col(f"a.{x}")) for x in axes))
    return ends.select(*by, (far / F.nullif(F.col("b.t") - F.col("a.t"), F.lit(0.0))).alias("velocity"))


def cycle_windows(values: Column) -> Column:
    """A cyclic series seen from each of its n positions: structs ``start, window`` of the n samples around it, the middle one its own."""
    n = F.size(values)
    at = lambda i: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get(values, F.pmod(i + k - F.floor(n / 2).cast("int"), n)))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("start"), at(i).alias("window")))
