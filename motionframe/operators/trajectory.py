"""Trajectories: gaps, filling, resampling, time normalisation, derivatives and local regression.

All operators work on rows ``by, t, values`` and are one window sort by (``by``, ``t``). Nearest later values come from
a window in descending order, so every frame only ever grows at one end.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

#: Points and neighbours fitted at once.
CELLS = 1 << 18

_PAST = (Window.unboundedPreceding, Window.currentRow)


def _known(df: DataFrame, by: list[str], order: list[Column], what: Column) -> Column:
    """The latest non-null ``what`` up to this row in the given order."""
    return F.last(what, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*_PAST))


def with_neighbours(df: DataFrame, by: list[str], t: str, v: str, extra: list[str] = ()) -> DataFrame:
    """``prev_t, prev_v, next_t, next_v``: the knots (non-null values) at or before and at or after each row."""
    knot = F.when(F.col(v).isNotNull(), F.struct(F.col(t).alias("t"), F.col(v).alias("v")))
    up, down = [F.col(t), *map(F.col, extra)], [F.desc(t), *map(F.desc, extra)]
    out = df.withColumn("_prev", _known(df, by, up, knot)).withColumn("_next", _known(df, by, down, knot))
    return out.select(*df.columns, F.col("_prev.t").alias("prev_t"), F.col("_prev.v").alias("prev_v"), F.col("_next.t").alias("next_t"), F.col("_next.v").alias("next_v"))


def _blend(t: Column) -> Column:
    """The straight line between the two knots; a knot itself where they coincide; null outside them."""
    share = (t - F.col("prev_t")) / F.nullif(F.col("next_t") - F.col("prev_t"), F.lit(0.0))
    return F.coalesce(F.col("prev_v") + (F.col("next_v") - F.col("prev_v")) * share, F.when(F.col("prev_t") == F.col("next_t"), F.col("prev_v")))


def fill_gaps(df: DataFrame, by: list[str], t: str, v: str) -> DataFrame:
    """``filled``: missing values inside a trajectory by the line between the nearest knots; leading and trailing ones stay null."""
    near = with_neighbours(df, by, t, v)
    return near.select(*df.columns, F.coalesce(F.col(v), _blend(F.col(t))).alias("filled"))


def detect_gaps(df: DataFrame, by: list[str], t: str, v: str) -> DataFrame:
    """``by, start_t, end_t, points``: maximal runs of missing values."""
    missing = F.col(v).isNull()
    whole, own = Window.partitionBy(*by).orderBy(t), Window.partitionBy(*by, missing).orderBy(t)
    island = df.withColumn("_run", F.row_number().over(whole) - F.row_number().over(own)).where(missing)
    return island.groupBy(*by, "_run").agg(F.min(t).alias("start_t"), F.max(t).alias("end_t"), F.count("*").alias("points")).drop("_run")


def resample(df: DataFrame, by: list[str], t: str, v: str, source: int, target: int) -> DataFrame:
    """``by, nth, t, v`` at rate ``target`` from rate ``source``: points evenly inserted up to the common multiple, filled, every k-th kept."""
    common = source * target // gcd(source, target)
    up, down = common // source, common // target
    order = Window.partitionBy(*by).orderBy(t)
    filled = fill_gaps(df, by, t, v).withColumn("_n", F.row_number().over(order)).withColumn("_t1", F.lead(t).over(order)).withColumn("_v1", F.lead("filled").over(order))
    grown = filled.withColumn("_i", F.explode(F.when(F.col("_t1").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(up - 1)))))
    share = F.col("_i") / F.lit(float(up))
    moved = lambda a, b: F.when(F.col("_i") == 0, F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * share)
    nth = (F.col("_n") - 1) * up + F.col("_i")
    return grown.where(nth % down == 0).select(*by, F.floor(nth / down).cast("long").alias("nth"), moved(t, "_t1").alias("t"), moved("filled", "_v1").alias("v"))


def time_normalise(df: DataFrame, by: list[str], t: str, v: str, points: int) -> DataFrame:
    """``by, nth, t, v``: values at ``points`` evenly spaced inner times of each trajectory, each on the line between its knots."""
    span = df.groupBy(*by).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"))
    asked = span.withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(points))))
    asked = asked.select(*by, F.col("nth").cast("long").alias("nth"), (F.col("_t0") + F.col("nth") * (F.col("_t1") - F.col("_t0")) / F.lit(float(points + 1))).alias("t"), F.lit(None).cast("double").alias("v"))
    knots = df.select(*by, F.lit(None).cast("long").alias("nth"), F.col(t).alias("t"), F.col(v).cast("double").alias("v"))
    near = with_neighbours(knots.unionByName(asked), by, "t", "v")
    return near.where(F.col("nth").isNotNull()).select(*by, "nth", "t", _blend(F.col("t")).alias("v"))


def knot_derivatives(df: DataFrame, by: list[str], t: str, v: str) -> DataFrame:
    """``by, t, v, velocity, acceleration, jerk`` of the non-null values, by backward differences."""
    order = Window.partitionBy(*by).orderBy(t)
    out, of = df.where(F.col(v).isNotNull()), v
    for name in ("velocity", "acceleration", "jerk"):
        out = out.withColumn(name, (F.col(of) - F.lag(of).over(order)) / F.nullif(F.col(t) - F.lag(t).over(order), F.lit(0.0)))
        of = name
    return out.select(*by, t, v, "velocity", "acceleration", "jerk")


def smooth_reach(df: DataFrame, by: list[str], t: str, v: str, reach: float) -> DataFrame:
    """``lowess`` over as many points as ``reach`` of time holds on average in a trajectory."""
    known = F.when(F.col(v).isNotNull(), F.col(t))
    whole = Window.partitionBy(*by)
    spans = df.where(F.col(v).isNotNull()).withColumn("_span", F.lit(reach) / F.nullif(F.max(known).over(whole) - F.min(known).over(whole), F.lit(0.0)))
    return lowess(spans, by, t, v, F.coalesce("_span", F.lit(1.0)))


def _fitted(t: np.ndarray, v: np.ndarray, first: np.ndarray, n: np.ndarray, k: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The local regression at ``rows`` of points sorted by time; a row's trajectory is the ``n`` points from ``first`` on, its neighbours the nearest ``k``."""
    last = first + n - k  # neighbours are consecutive: from where on, between these two
    low, high = np.maximum(first, rows - k + 1), np.minimum(last, rows)
    while True:  # the first place from which on the one after the neighbours is not nearer than their first
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            break
        middle = (low[open_] + high[open_]) // 2
        here = t[rows[open_]]
        moved = np.abs(t[middle] - here) > np.abs(t[middle + k[open_]] - here)
        low[open_], high[open_] = np.where(moved, middle + 1, low[open_]), np.where(moved, high[open_], middle)
    out, order = np.empty(len(rows)), np.argsort(k, kind="stable")
    at = 0
    while at < len(order):
        width = int(k[order[at]])
        end = min(int(np.searchsorted(k[order], width, "right")), at + max(1, CELLS // width))
        part = order[at:end]
        near = low[part, None] + np.arange(width)
        x, y = t[near] - t[rows[part], None], v[near]
        d = np.abs(x)
        reach = d.max(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            u = d / reach
        w = np.where(u <= 0.001, 1.0, np.where(u >= 0.999, 0.0, (1 - u**3) ** 3))
        w = np.where(reach == 0, 1.0, w)
        s, wx, wxx, wy, wxy = w.sum(axis=1), (w * x).sum(axis=1), (w * x * x).sum(axis=1), (w * y).sum(axis=1), (w * x * y).sum(axis=1)
        spread = s * wxx - wx * wx
        line = spread > 1e-9 * s * wxx
        out[part] = np.where(line, (wxx * wy - wx * wxy) / np.where(line, spread, 1.0), wy / s)
        at = end
    return out


def lowess(df: DataFrame, by: list[str], t: str, v: str, span: float | Column) -> DataFrame:
    """``smooth``: locally linear regression with tricube weights over the nearest ``span`` share of a trajectory's points.

    The neighbours of a point are consecutive in time. Trajectories are sorted and numbered by windows and then stream through the task, which holds no
    more of one than its points' neighbours; points are fitted many at a time, and no pair of them is a row.
    """
    order = Window.partitionBy(*by).orderBy(t)
    share = span if isinstance(span, Column) else F.lit(span)
    known = df.where(F.col(v).isNotNull()).select(*by, F.col(t).alias("t"), F.col(v).alias("v"), share.alias("_share"))
    ranked = known.withColumns({"_n": F.count("*").over(Window.partitionBy(*by)), "_r": F.row_number().over(order)})
    k = F.greatest(F.lit(2), F.least(F.col("_n"), F.floor(F.col("_n") * F.col("_share") + F.lit(1e-10))))
    sorted_ = ranked.withColumn("_k", F.least(k, F.col("_n")).cast("long")).drop("_share").sortWithinPartitions(*by, "_r")
    form = StructType([*[f for f in sorted_.schema.fields if f.name not in ("_n", "_r", "_k")], StructField("smooth", DoubleType())])
    target = to_arrow_schema(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fitted = None, 0  # rows that are not fitted yet or still neighbours, and how many of them are fitted
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            number, size, k = (held.column(c).to_numpy().astype(np.int64) for c in ("_r", "_n", "_k"))
            place = np.arange(len(number))
            ready = place + np.minimum(k - 1, size - number) < len(number)  # all points that may be neighbours are here
            end = len(ready) if ready.all() else max(fitted, int(np.argmin(ready)))
            if end > fitted:
                rows = np.arange(fitted, end)
                x, y = (held.column(c).cast(pa.float64()).to_numpy() for c in ("t", "v"))
                smooth = _fitted(x, y, (place - number + 1)[rows], size[rows], k[rows], rows)
                out = held.slice(fitted, end - fitted).select([f.name for f in target if f.name != "smooth"]).append_column("smooth", pa.array(smooth))
                yield from out.cast(target).to_batches()
            least = len(number) if end == len(number) else max(0, int(np.maximum(place - number + 1, place - k + 1)[end:].min()))
            held, fitted = (held.slice(least), end - least) if least < len(number) else (None, 0)

    return sorted_.mapInArrow(run, form)
