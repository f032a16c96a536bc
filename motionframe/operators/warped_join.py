"""Pairs of series within a radius of warping cost, without the matrix of all costs.

A path lays the first samples on each other and the last ones too, and the highest and lowest sample of one on some sample of the other. So series
within the radius are near in their first and last samples, by which they are posted to cells, and in their extrema. Pairs that
meet are bounded again by the envelopes of their segments; a cost is worked out only where no bound exceeds the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .cluster import dbscan, dtw_cost

#: Segments whose envelopes bound a cost, series of a cell in one tile, pairs bounded at once, such blocks after which a task may stop bounding.
SEGMENTS, TILE, BLOCK, TRIAL = 8, 100, 128, 4


def envelope_bound(x: np.ndarray, y: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """A lower bound of the unconstrained warping cost of each pair of rows: a path over segments instead of samples.

    The samples of one segment of ``x`` are laid on a stretch of segments of ``y``, each at least as far as from the nearest envelope in the
    stretch; the next segment's stretch begins where this one ends, or right after.
    """
    n = y.shape[1]
    cuts = np.unique(np.linspace(0, n, min(segments, n) + 1).astype(int)[:-1])
    own = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)[:-1])
    low, high = np.minimum.reduceat(y, cuts, axis=1), np.maximum.reduceat(y, cuts, axis=1)
    apart = np.maximum(np.maximum(low[:, None, :] - x[:, :, None], x[:, :, None] - high[:, None, :]), 0)
    s, best = len(cuts), None
    stretch = [np.add.reduceat(np.minimum.accumulate(apart[:, :, j:], axis=2), own, axis=1) for j in range(s)]  # by where it begins: pairs x segments x ends
    for i in range(len(own)):
        new = np.full((len(x), s), np.inf)
        for j in range(s if i else 1):
            before = 0.0 if i == 0 else best[:, j] if j == 0 else np.minimum(best[:, j], best[:, j - 1])
            new[:, j:] = np.minimum(new[:, j:], stretch[j][:, i] + np.reshape(before, (-1, 1)))
        best = new
    return best[:, -1]


def _met(home: DataFrame, guests: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """All rows of ``home`` beside those of ``guests`` in the same cell, the pairs of a crowded cell dealt by tiles to as many tasks as they take."""
    sizes = [d.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias(n)) for d, n in ((home, "_m"), (guests, "_n"))]
    both = sizes[0].join(sizes[1], keys)
    first = home.join(both, keys).withColumn("_i", F.pmod(F.xxhash64("a"), F.col("_m")).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_m", "_n")
    second = guests.join(both, keys).withColumn("_j", F.pmod(F.xxhash64("b"), F.col("_n")).cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).drop("_m", "_n")
    return first.join(second, [*keys, "_i", "_j"])


def warped_candidates(series: DataFrame, by: list[str], key: str, values: str, eps: float, tile: int = TILE, segments: int = SEGMENTS) -> DataFrame:
    """``by, a, b, x, y``: the pairs a < b of a class that no bound keeps from a cost of ``eps`` at most; the costs that are worked out.

    Missing samples count 0, as in ``dtw_cost``. All series have one length. Null series take no part.
    """
    plain = F.transform(values, lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)))
    rows = series.where(F.col(values).isNotNull() & (F.size(values) > 0)).select(*by, F.col(key).alias("k"), plain.alias("x"))
    radius = F.lit(float(eps) * 2**0.5) * F.size("x")
    facts = rows.select("*", radius.alias("r"), F.get("x", F.lit(0)).alias("first"), F.get("x", F.size("x") - 1).alias("last"), F.array_max("x").alias("high"), F.array_min("x").alias("low"))
    cell = lambda c: F.floor(F.greatest(F.least(F.col(c) / F.greatest(F.col("r"), F.lit(1e-6)), F.lit(1e17)), F.lit(-1e17)))
    facts = facts.withColumn("c", cell("first")).withColumn("d", cell("last"))
    sides = ("x", "first", "last", "high", "low")
    home = facts.select(*by, "c", "d", F.col("k").alias("a"), "r", *[F.col(c).alias(f"a_{c}") for c in sides])
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    guests = facts.withColumn("_o", F.explode(around)).select(*by, (F.col("c") + F.col("_o.i")).alias("c"), (F.col("d") + F.col("_o.j")).alias("d"), F.col("k").alias("b"), *[F.col(c).alias(f"b_{c}") for c in sides])
    apart = lambda c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))
    slack = F.col("r") * (1 + 1e-9)  # bounds and costs are summed in another order
    ends = F.when(F.size("a_x") > 1, apart("first") + apart("last")).otherwise(apart("first"))
    near = _met(home, guests, [*by, "c", "d"], tile).where((F.col("a") < F.col("b")) & (ends <= slack) & (apart("high") <= slack) & (apart("low") <= slack))

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tried = passed = 0
        for pdf in batches:
            for lo in range(0, len(pdf), BLOCK):
                part = pdf.iloc[lo : lo + BLOCK]
                if tried >= TRIAL * BLOCK and passed > 0.9 * tried:  # bounds that hardly exclude a pair are not worth their time; its cost decides
                    yield part[[*by, "a", "b", "x", "y"]]
                    continue
                x, y = (np.stack(part[c].to_numpy()) for c in ("x", "y"))
                keep = np.maximum(envelope_bound(x, y, segments), envelope_bound(y, x, segments)) <= part["r"].to_numpy() * (1 + 1e-9)
                tried, passed = tried + len(part), passed + int(keep.sum())
                yield part.loc[keep, [*by, "a", "b", "x", "y"]]

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    name = rows.schema["k"].dataType.simpleString()
    return near.select(*by, "a", "b", F.col("a_x").alias("x"), F.col("b_x").alias("y"), "r").mapInPandas(bounded, f"{kinds}, a {name}, b {name}, x array<double>, y array<double>")


def warped_within(series: DataFrame, by: list[str], key: str, values: str, eps: float, tile: int = TILE) -> DataFrame:
    """``by, a, b, d``: the pairs a < b of a class whose warping cost, over length and the root of two, is ``eps`` at most."""
    near = warped_candidates(series, by, key, values, eps, tile)
    return dtw_cost(near, [*by, "a", "b"], "x", "y").withColumnRenamed("cost", "d").where(F.col("d") <= F.lit(float(eps)))


def tiled_within(series: DataFrame, by: list[str], key: str, values: str, eps: float) -> DataFrame:
    """``warped_within``'s rows for series whose cells exclude few pairs: tiles meet in tasks, pairs are bounded there and left as soon as their paths cost too much; only pairs within the radius become rows."""
    rows = series.where(F.col(values).isNotNull() & (F.size(values) > 0)).select(*by, key, values, F.lit(float(eps)).alias("_eps"))
    return tiles.matrix(rows, by, key, values, tiles.by_warping(eps=float(eps)), within="_eps")


def radius_clusters(series: DataFrame, by: list[str], key: str, values: str, eps: float, min_pts: int) -> DataFrame:
    """``by, a, cluster``: density clusters under warping at a given radius; no cost beyond it is needed, so none is worked out."""
    points = series.select(*by, F.col(key).alias("a"))
    return dbscan(tiled_within(series, by, key, values, eps), points, by, F.lit(float(eps)), min_pts)


def cost_share(series: DataFrame, by: list[str], candidates: DataFrame) -> float:
    """The share of all pairs of the classes that are candidates."""
    pairs = series.groupBy(*by).count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0.0
    return candidates.count() / pairs if pairs else 0.0
