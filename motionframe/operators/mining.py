"""Pairs of instants of periodic shapes, judged by how well the slopes between them tell the phases apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from . import cluster, cuts, pairs


def key_pairs(templates: DataFrame, keys: list[str], values: str, neighbour: int = 2, crowd: int = 10) -> DataFrame:
    """``keys, a, b, support``: in how many windows of a closed shape two events lie, as offsets from the window's middle, ``neighbour`` apart at least.

    The shape is seen from each of its places, one whole period at a time. Events are the extrema more persistent than the middle persistence if there are more than ``crowd``
    (those at the window's ends left out then), all of them else; and the global minimum. Persistences below ``cluster.FAINT`` make no event of their own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                y = np.asarray(row[-1], np.float64)
                n = len(y)
                middle, count = (n + 1) // 2, {}
                for start in range(n):
                    window = np.roll(y, -(n // 2) - start)
                    found = cluster.persistence(window)
                    heights = sorted(p for *_, p in found if p >= cluster.FAINT)
                    least = 0.0
                    if len(heights) > crowd:
                        least = heights[len(heights) // 2]
                        found = [f for f in found if not {f[0], f[1]} & {0, n - 1}]
                    events = sorted({i for lo, hi, p in found if p > least for i in (lo, hi)} | {int(window.argmin())})
                    for k, a in enumerate(events):
                        for b in events[k + 1 :]:
                            if b - a >= neighbour:
                                count[a - middle, b - middle] = count.get((a - middle, b - middle), 0) + 1
                out += [(*row[:-1], a, b, c) for (a, b), c in count.items()]
            yield pd.DataFrame(out, columns=[*keys, "a", "b", "support"])

    kinds = ", ".join(f"{k} {templates.schema[k].dataType.simpleString()}" for k in keys)
    return templates.select(*keys, values).mapInPandas(run, f"{kinds}, a int, b int, support long")


def window_slopes(templates: DataFrame, candidates: DataFrame, channel: str, key: str, values: str, labels: str) -> DataFrame:
    """``channel, a, b, key, at, kind, label, x``: for each candidate pair and every place of every shape of its channel three slopes.

    ``left`` runs from the instant ``a`` places off to the place, ``right`` from the place to the one ``b`` off, ``all`` between the two; instants go around the shape's
    ends. ``label`` is the place's. A slope between a place and itself, or with a missing sample, is left out.
    """
    n = F.size(values)
    met = templates.select(channel, key, F.col(values).alias("_v"), F.col(labels).alias("_l"), n.alias("_n")).join(candidates.select(channel, "a", "b"), channel)
    at = met.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    place = F.col("at") / (F.col("_n") - 1)

    def off(c: str) -> Column:
        there = place + F.col(c) / F.col("_n")
        wrapped = F.when(there > 1.0, there - 1.0).when(there < 0.0, there + 1.0).otherwise(there)
        return F.least(F.greatest((wrapped * (F.col("_n") - 1)).cast("int"), F.lit(0)), F.col("_n") - 1)

    at = at.withColumn("_i", off("a")).withColumn("_j", off("b"))
    sample = lambda i: F.get("_v", F.col(i)).cast("double")
    slope = lambda i, j: (sample(i) - sample(j)) / F.nullif(F.col(i) / F.col("_n") - F.col(j) / F.col("_n"), F.lit(0.0))
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), slope(i, j).alias("x")) for kind, i, j in (("left", "_i", "at"), ("right", "at", "_j"), ("all", "_i", "_j"))])
    rows = at.select(channel, "a", "b", key, "at", F.get("_l", F.col("at")).alias("label"), F.explode(each).alias("s"))
    return rows.select(channel, "a", "b", key, "at", "s.kind", "label", "s.x").where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")) & F.col("label").isNotNull())


def class_quality(slopes: DataFrame, by: list[str], row: list[str], label: str, x: str, labels: list[int], draws: int = 4, seed: int = 1) -> DataFrame:
    """``by, l1, l2, quality``: the best cut's quality between every two of ``labels``, l1 < l2.

    With ``draws`` it is the mean over as many draws that take as many rows of every class as the rarest has (those of smallest hash of ``row``, which
    tells rows apart); a candidate that lacks a class has none. Without, all rows count. Classes that no cut parts have no row.
    """
    kept = slopes.where(F.col(label).isin(labels)).select(*by, *row, F.col(label).cast("int").alias(label), x)
    names = sorted(labels)
    if not draws:
        return cuts.pair_cuts(kept, by, x, label, names).select(*by, "l1", "l2", "quality")
    found = cuts.pair_cuts(drawn(kept, by, row, label, len(names), draws, seed), by, x, label, names, [f"_draw{d}" for d in range(draws)])
    return found.groupBy(*by, "l1", "l2").agg(F.avg("quality").alias("quality"))


def drawn(rows: DataFrame, by: list[str], row: list[str], label: str, classes: int, draws: int, seed: int) -> DataFrame:
    """``rows`` of the groups that have all ``classes``, with ``_draw0``, ``_draw1``, ..: 1 for each draw that takes the row, else 0.

    A draw takes as many rows of a class as the rarest has, those of least hash, then of least ``row``. Hashes are counted by their first byte; only rows whose byte
    is that of the last one taken are ranked, so no class is sorted.
    """
    checkpoint_dir(rows.sparkSession)
    hashes = F.array(*[F.xxhash64(F.lit(d).cast("int"), F.lit(seed), *row) for d in range(draws)])
    hashed = rows.select(*by, label, *row, F.posexplode(hashes).alias("draw", "_h")).withColumn("_byte", F.shiftright("_h", 56))
    counted = hashed.groupBy(*by, label, "draw", "_byte").agg(F.count("*").alias("n"))
    sizes = counted.where("draw = 0").groupBy(*by, label).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.min("n").alias("_least"), F.count("*").alias("_classes")).where(F.col("_classes") == classes).drop("_classes")
    line = Window.partitionBy(*by, label, "draw").orderBy("_byte")
    ends = counted.withColumn("_upto", F.sum("n").over(line)).join(sizes, by).where((F.col("_upto") >= F.col("_least")) & (F.col("_upto") - F.col("n") < F.col("_least")))
    ends = ends.select(*by, label, "draw", "_byte", (F.col("_least") - (F.col("_upto") - F.col("n"))).alias("_rank")).checkpoint()
    small = F.broadcast if ends.count() <= cuts.SENT else lambda d: d
    order = Window.partitionBy(*by, label, "draw").orderBy("_h", *row)
    last = hashed.join(small(ends), [*by, label, "draw", "_byte"]).withColumn("_r", F.row_number().over(order)).where("_r = _rank").select(*by, label, "draw", F.struct("_h", *row).alias("_last"))
    lasts = last.groupBy(*by, label).agg(F.map_from_entries(F.collect_list(F.struct("draw", "_last"))).alias("_lasts")).checkpoint()
    met = rows.join(small(lasts), [*by, label])
    taken = lambda d: F.struct(F.xxhash64(F.lit(d).cast("int"), F.lit(seed), *row).alias("_h"), *row) <= F.try_element_at("_lasts", F.lit(d))
    return met.select(*rows.columns, *[taken(d).cast("int").alias(f"_draw{d}") for d in range(draws)])


def summed_quality(qualities: DataFrame, candidates: DataFrame, channel: str) -> DataFrame:
    """``channel, a, b, total``: every candidate's qualities summed over the pairs of classes, 0 where it has none."""
    sums = qualities.groupBy(channel, "a", "b").agg(F.sum("quality").alias("_total"))
    return candidates.select(channel, "a", "b").distinct().join(sums, [channel, "a", "b"], "left").select(channel, "a", "b", F.coalesce("_total", F.lit(0.0)).alias("total"))


def select_pairs(totals: DataFrame, channel: str, budget: int) -> DataFrame:
    """``channel, a, b, total, rank``: the budget shared by the channels in proportion to their mean total, each channel's best. Ties go to the smaller offsets."""
    shares = pairs.allocate(totals.groupBy(channel).agg(F.avg("total").alias("mean")), "mean", budget)
    return pairs.top_by_share(totals, shares, [channel], [F.desc("total"), F.col("a"), F.col("b")])
