"""Mean shapes that carry labels: barycentres under label-aware warping, and clustered templates of periodic channels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from . import cluster, tiles


def _upper_median(rows: DataFrame, by: str, position: str, name: str) -> DataFrame:
    """``by, name``: the upper middle position, from how many rows have each."""
    counted = rows.groupBy(by, position).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(by).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = counted.withColumn("_passed", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(Window.partitionBy(by)))
    return passed.where(F.col("_passed") > F.floor(F.col("_n") / 2)).groupBy(by).agg(F.min(position).alias(name))


def seeds(series: DataFrame, by: str, key: str, values: str, labels: str) -> DataFrame:
    """``by, shape, marks, members``: each class's series whose detrended extremes are closest, in squares, to the class's upper median positions; then the smallest key."""
    flat = cluster.detrend(F.col(values))
    placed = series.select(by, key, F.transform(values, lambda v: v.cast("double")).alias("x"), F.col(labels).alias("m"), cluster.arg_last(flat, False).alias("lo"), cluster.arg_last(flat, True).alias("hi"))
    middle = _upper_median(placed, by, "lo", "mlo").join(_upper_median(placed, by, "hi", "mhi"), by)
    square = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    ranked = placed.join(middle, by).withColumn("_d", F.struct(square("lo", "mlo") + square("hi", "mhi"), F.col(key)))
    best = ranked.groupBy(by).agg(F.min_by(F.struct("x", "m"), "_d").alias("s"), F.count("*").alias("members"))
    return best.select(by, F.col("s.x").alias("shape"), F.col("s.m").alias("marks"), "members")


def align(x: np.ndarray, marks: np.ndarray, shape: np.ndarray, shares: np.ndarray, table: np.ndarray, lam: float | None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Warping costs of each series to its shape, over length and the root of two, and the paths' cells as (rows, samples, frames).

    ``shares[row, frame, label]`` is how much of a frame has each label. With ``lam`` a cell's signed difference is multiplied by the mean label distance of the
    sample to the frame and costs exp(-d / lam); without, the plain distance counts and labels do not.
    """
    factor = None
    if lam is not None and lam >= 0:
        factor = np.einsum("pil,pjl->pij", table[marks], shares)
        empty = shares.sum(axis=2) == 0
        factor = np.where(empty[:, None, :], 1.0, factor)
    cost, step = cluster.dtw_batch(x, shape, factor, lam)
    i, j, rows = np.full(len(x), x.shape[1]), np.full(len(x), shape.shape[1]), np.arange(len(x))
    cells = []
    while len(rows):
        cells.append((rows, i[rows] - 1, j[rows] - 1))
        way = step[i[rows], j[rows], rows]
        i[rows] -= way != 2
        j[rows] -= way != 1
        rows = rows[(i[rows] > 0) & (j[rows] > 0)]
    return cost[-1, -1] / (x.shape[1] * 2**0.5), cells


def labelled_barycentres(series: DataFrame, by: str, key: str, values: str, labels: str, table: np.ndarray, lam: float | None = 10.0, rounds: int = 100) -> DataFrame:
    """``by, frame, value, label, share, members``: each class's mean shape and its labels, both carried through the warping.

    ``labels`` are ints from 0 on, rows of ``table`` their distances. In a round every series is warped to its class's shape under the label distance to the frames' label shares (``align``);
    what falls on a frame gives its next value and shares. A class is done when its shape and shares have been there before, all are after ``rounds``. A frame's label is the one of
    most say over all rounds: a sample's say is (most - cost) / (most - least) of its series' cost among all of the class's, 1 where all cost
    the same; the smallest of equals. ``share`` is its part of the say. Classes of one series keep its values and labels.
    """
    checkpoint_dir(series.sparkSession)
    count = len(table)
    seen = lambda shape, shares: F.xxhash64(F.transform(shape, lambda v: F.round(v, 9)), F.transform(F.flatten(shares), lambda v: F.round(v, 9)))
    one_hot = F.transform("marks", lambda m: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: (k == m).cast("double")))
    shapes = seeds(series, by, key, values, labels).withColumn("shares", one_hot).select(by, "shape", "shares", "members")
    shapes = shapes.withColumn("_seen", F.array(seen(F.col("shape"), F.col("shares")))).checkpoint()
    placed = series.select(by, F.transform(values, lambda v: v.cast("double")).alias("x"), F.col(labels).alias("m"))
    kind = series.schema[by].dataType.simpleString()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, owner = np.unique(pdf[by].to_numpy(), return_inverse=True)
            total = low = high = None
            for at in range(0, len(pdf), 128):
                part = pdf.iloc[at : at + 128]
                x, marks, shape = (np.stack(part[c].to_numpy()) for c in ("x", "m", "shape"))
                shares = np.stack([np.stack(s) for s in part["shares"]])
                own = owner[at : at + 128]
                if total is None:
                    total, low, high = np.zeros((3, len(names), shape.shape[1], count)), np.full(len(names), np.inf), np.full(len(names), -np.inf)
                cost, cells = align(x, marks, shape, shares, table, lam)
                np.minimum.at(low, own, cost)
                np.maximum.at(high, own, cost)
                for rows, i, j in cells:
                    where = (own[rows], j, marks[rows, i])
                    for k, what in enumerate((1.0, x[rows, i], cost[rows])):
                        np.add.at(total[k], where, what)
            if total is not None:
                c, f, m = np.nonzero(total[0])
                yield pd.DataFrame({by: names[c], "frame": f.astype(np.int32), "mark": m.astype(np.int32), "n": total[0][c, f, m], "sx": total[1][c, f, m], "sc": total[2][c, f, m], "lo": low[c], "hi": high[c]})

    moving, said, send = shapes.select(by), None, cluster.sender(shapes)
    for _ in range(rounds):
        met = placed.join(send(shapes.select(by, "shape", "shares").join(moving, by, "left_semi")), by)
        found = met.mapInPandas(sums, f"{by} {kind}, frame int, mark int, n double, sx double, sc double, lo double, hi double")
        found = found.groupBy(by, "frame", "mark").agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sc").alias("sc"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).checkpoint()
        more = found.select(by, "frame", "mark", "n", "sc", "lo", "hi")
        said = more if said is None else said.union(more).groupBy(by, "frame", "mark").agg(F.sum("n").alias("n"), F.sum("sc").alias("sc"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).checkpoint()
        frames = found.groupBy(by, "frame").agg((F.sum("sx") / F.sum("n")).alias("v"), F.map_from_entries(F.collect_list(F.struct("mark", "n"))).alias("by_mark"), F.sum("n").alias("all"))
        shares = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.coalesce(F.try_element_at("by_mark", k), F.lit(0.0)) / F.col("all"))
        new = frames.select(by, F.struct("frame", "v", shares.alias("s")).alias("p")).groupBy(by).agg(F.array_sort(F.collect_list("p")).alias("p"))
        new = new.select(by, F.transform("p", lambda q: q["v"]).alias("_next"), F.transform("p", lambda q: q["s"]).alias("_shares"))
        fresh = F.col("_next").isNotNull() & ~F.array_contains("_seen", seen(F.col("_next"), F.col("_shares")))
        both = shapes.join(new, by, "left").select(
            by, F.coalesce("_next", "shape").alias("shape"), F.coalesce("_shares", "shares").alias("shares"), "members", fresh.alias("_moved"),
            F.when(fresh, F.array_append("_seen", seen(F.col("_next"), F.col("_shares")))).otherwise(F.col("_seen")).alias("_seen"),
        ).checkpoint()
        shapes, moving = both.drop("_moved"), both.where("_moved").select(by)
        if moving.isEmpty():
            break
    ends = said.groupBy(by).agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
    wide = F.col("_hi") - F.col("_lo")
    say = F.when(wide > 0, (F.col("n") * F.col("_hi") - F.col("sc")) / wide).otherwise(F.col("n"))
    votes = said.join(ends, by).select(by, "frame", "mark", F.greatest(say, F.lit(0.0)).alias("say"))
    won = votes.groupBy(by, "frame").agg(F.min_by("mark", F.struct(-F.round("say", 9), F.col("mark"))).alias("label"), (F.max("say") / F.nullif(F.sum("say"), F.lit(0.0))).alias("share"))
    points = shapes.select(by, F.posexplode("shape").alias("frame", "value"), "members")
    return points.join(won, [by, "frame"], "left").select(by, "frame", "value", "label", "share", "members")


def clustered_templates(series: DataFrame, by: list[str], key: str, values: str, labels: str, table: np.ndarray, lam: float | None = 10.0, order: int = 5, bins: int = 100, rounds: int = 100, edge: float | None = None, eps: float | None = None, aware: bool = True) -> DataFrame:
    """``by, cluster, values, labels, members``: label-aware distances within a class, density clusters, one labelled mean shape per cluster.

    There are two ways to measure: with labels (``aware``), or on the samples alone, for distances and barycentres both; labels are voted in either.
    ``order`` is how many bin means the estimated radius may rest on.

    The radius is estimated from all distances, or is ``eps`` (then three series make a core). Series with missing samples take no part. With ``edge`` that share of a shape at both ends ramps to the middle of its
    ends, so that a cycle closes.
    """
    checkpoint_dir(series.sparkSession)
    whole = series.where(~F.exists(values, lambda v: v.isNull() | F.isnan(v)))
    points = whole.select(*by, F.col(key).alias("a"))
    measure, extra = (tiles.by_warping(labels=labels, table=table), [labels]) if aware else (tiles.by_warping(), [])
    if eps is None:
        settings = tiles.estimate_eps(whole, by, key, values, measure, order, bins, points, extra)
    else:
        settings = points.select(*by).distinct().withColumns({"eps": F.lit(float(eps)), "min_pts": F.lit(3)})
    member = tiles.radius_clusters(whole, by, key, values, measure, settings, extra)
    named = whole.join(member.withColumnRenamed("a", key), [*by, key]).withColumn("_group", F.to_json(F.struct(*by, "cluster"))).checkpoint()
    shapes = labelled_barycentres(named, "_group", key, values, labels, table, lam if aware else None, rounds)
    held = shapes.groupBy("_group", "members").agg(F.array_sort(F.collect_list(F.struct("frame", "value", "label"))).alias("p"))
    rows = named.select("_group", *by, "cluster").distinct().join(held, "_group").select(*by, "cluster", F.transform("p", lambda q: q["value"]).alias("values"), F.transform("p", lambda q: q["label"]).alias("labels"), "members")
    return rows if edge is None else rows.withColumn("values", cluster.edge_blend(F.col("values"), edge))
