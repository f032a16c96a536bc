"""Distances between series, density clusters, barycentres and the series functions around them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

MAX_ROUNDS = 100

#: Shapes that are sent to every task at most.
SHAPES = 10_000


def sender(shapes: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What marks these shapes' later states to be sent to every task if there are at most ``SHAPES``, so that series stay where they are in every round."""
    return F.broadcast if shapes.limit(SHAPES + 1).count() <= SHAPES else lambda later: later


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def pairs_within(series: DataFrame, by: list[str], key: str, columns: dict[str, tuple[str, str]], tile: int = 500) -> DataFrame:
    """``by, a, b`` and for each of ``columns`` its values of both, for all pairs a < b of a class.

    A class's series are dealt to tiles of about ``tile`` by their key, and two tiles meet in one join key, so that the pairs of one large
    class are spread over many tasks. There are as many rows as pairs: that is what a distance matrix is.
    """
    tiles = series.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("_tiles"))
    dealt = series.join(tiles, by).withColumn("_t", F.pmod(F.xxhash64(key), F.col("_tiles")).cast("int"))
    first = dealt.select(*by, F.col(key).alias("a"), *[F.col(c).alias(x) for c, (x, _) in columns.items()], F.col("_t").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_j"))
    second = dealt.select(*by, F.col(key).alias("b"), *[F.col(c).alias(y) for c, (_, y) in columns.items()], F.col("_t").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_i"))
    return first.join(second, [*by, "_i", "_j"]).where(F.col("a") < F.col("b")).drop("_i", "_j")


def distance_matrix(series: DataFrame, by: list[str], key: str, values: str) -> DataFrame:
    """``by, a, b, d``: L1 distances of the pairs a < b within a class."""
    return pairs_within(series, by, key, {values: ("_x", "_y")}).select(*by, "a", "b", l1(F.col("_x"), F.col("_y")).alias("d"))


def both_ways(distances: DataFrame, by: list[str]) -> DataFrame:
    return distances.select(*by, F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "d").select(*by, "p.a", "p.b", "d")


def knn_mean(distances: DataFrame, by: list[str], k: int, once: bool = True) -> DataFrame:
    """``by, a, mean``: each point's mean distance to its ``k`` nearest; ``distances`` has a pair ``once`` or both ways."""
    near = Window.partitionBy(*by, "a").orderBy("d", "b")
    ranked = (both_ways(distances, by) if once else distances).withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k)
    return ranked.groupBy(*by, "a").agg(F.avg("d").alias("mean"))


def trimmed_bucket_mean(distances: DataFrame, by: list[str], order: int, bins: int, trim: float = 0.012) -> DataFrame:
    """``by, a, k, mean``: per point the mean of the ``k`` smallest bin means, k from 3 to ``order``, of its distances without ``trim`` of the range at both ends."""
    whole = both_ways(distances, by)
    ends = whole.groupBy(*by, "a").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    inside = whole.join(ends, [*by, "a"]).withColumn("w", F.col("hi") - F.col("lo")).where((F.col("d") >= F.col("lo") + F.col("w") * trim) & (F.col("d") <= F.col("hi") - F.col("w") * trim))
    bin_of = F.floor((F.col("d") - F.col("lo")) / F.nullif(F.col("w"), F.lit(0.0)) * bins)
    return least_bin_means(inside.groupBy(*by, "a", bin_of.alias("bin")).agg(F.avg("d").alias("m")), by, order)


def least_bin_means(means: DataFrame, by: list[str], order: int) -> DataFrame:
    """``by, a, k, mean``: the mean of each point's ``k`` smallest bin means, k from 3 to ``order``. ``means``: ``by, a, bin, m``."""
    ranked = means.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "a").orderBy("m")))
    wide = ranked.withColumn("k", F.explode(F.sequence(F.lit(3), F.lit(order)))).where(F.col("_r") <= F.col("k"))
    return wide.groupBy(*by, "a", "k").agg(F.avg("m").alias("mean"))


#: The radius and count of a class whose distances say nothing (a single series, or all alike).
NO_EPS, NO_POINTS = 0.1, 3


def estimate_eps(distances: DataFrame, by: list[str], order: int = 5, bins: int = 100, classes: DataFrame | None = None) -> DataFrame:
    """``by, eps, min_pts``: the k whose average over the points is smallest, and that average.

    With one average above zero the first k's is taken; with none ``NO_EPS, NO_POINTS``, as for those of ``classes`` without distances.
    """
    return suggested_eps(trimmed_bucket_mean(distances, by, order, bins), (classes if classes is not None else distances), by)


def suggested_eps(means: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """``estimate_eps`` from the points' means (``by, a, k, mean``)."""
    per_k = means.groupBy(*by, "k").agg(F.avg("mean").alias("eps"))
    found = per_k.groupBy(*by).agg(F.sum((F.col("eps") > 0).cast("int")).alias("_above"), F.min("eps").alias("_eps"), F.min_by("k", F.struct("eps", "k")).alias("_k"), F.min_by("eps", "k").alias("_first"), F.min("k").alias("_k0"))
    found = classes.select(*by).distinct().join(found, by, "left")
    pick = lambda many, one, none: F.when(F.col("_above") > 1, F.col(many)).when(F.col("_above") == 1, F.col(one)).otherwise(F.lit(none))
    return found.select(*by, pick("_eps", "_first", NO_EPS).alias("eps"), pick("_k", "_k0", NO_POINTS).cast("int").alias("min_pts"))


def components(edges: DataFrame) -> DataFrame:
    """``id, root``: the smallest id reachable from every node that an edge (``a, b``, any comparable type) has.

    Every round hangs a node's larger neighbours, then its smaller ones, onto its smallest neighbour, until nothing changes: a logarithmic number
    of rounds, each cut from its lineage.
    """
    checkpoint_dir(edges.sparkSession)
    work = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    for _ in range(MAX_ROUNDS):
        both = work.select("u", "v").union(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        work = small.where(F.col("u") != F.col("v")).distinct().checkpoint()
        state = work.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return work.select(F.col("u").alias("id"), F.col("v").alias("root")).union(work.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError("components did not settle")


def dbscan(distances: DataFrame, points: DataFrame, by: list[str], eps: Column | None = None, min_pts: int | None = None, settings: DataFrame | None = None) -> DataFrame:
    """``by, a, cluster``: density clusters named by their smallest core point; a border point joins the smallest adjacent one.

    A core has ``min_pts`` points (itself among them) within ``eps``; ``settings`` (``by, eps, min_pts``) gives both per class instead. Clusters of
    ``min_pts`` points or fewer are dropped; a class left without any is one cluster named 2 of all its points. ``points``: ``by, a``. Ids are
    those of a class: classes may share them.
    """
    checkpoint_dir(points.sparkSession)
    if settings is None:
        settings = points.select(*by).distinct().withColumns({"eps": eps, "min_pts": F.lit(min_pts)})
    near = both_ways(distances.join(settings, by).where(F.col("d") <= F.col("eps")), by).checkpoint()  # every later step reads it
    degree = near.groupBy(*by, "a").agg(F.count("*").alias("n"))
    cores = points.join(degree, [*by, "a"], "left").join(settings, by).where(F.coalesce("n", F.lit(0)) + 1 >= F.col("min_pts")).select(*by, "a").distinct()
    numbered = cores.withColumn("_n", F.monotonically_increasing_id()).checkpoint()  # plain numbers for the rounds, whatever the ids are
    ends = near.join(numbered.withColumnRenamed("_n", "_p"), [*by, "a"]).join(numbered.withColumnRenamed("a", "b").withColumnRenamed("_n", "_q"), [*by, "b"])
    rooted = components(ends.select(F.col("_p").alias("a"), F.col("_q").alias("b"))).withColumnRenamed("id", "_n")
    core = rooted_cores(numbered, rooted, by)
    border = near.join(core.withColumnRenamed("a", "b"), [*by, "b"]).groupBy(*by, "a").agg(F.min("root").alias("near"))
    return kept_clusters(points, core, border, settings, by)


def rooted_cores(numbered: DataFrame, rooted: DataFrame, by: list[str]) -> DataFrame:
    """``by, a, root``: the cores (``by, a, _n``) with the smallest core of their component (``_n, root``)."""
    placed = numbered.join(rooted, "_n", "left").withColumn("root", F.coalesce("root", "_n")).checkpoint()
    return placed.join(placed.groupBy("root").agg(F.min("a").alias("_first")), "root").select(*by, "a", F.col("_first").alias("root")).checkpoint()


def kept_clusters(points: DataFrame, core: DataFrame, border: DataFrame, settings: DataFrame, by: list[str]) -> DataFrame:
    """``dbscan``'s rows from the cores' roots and the smallest roots near each point (``by, a, near``)."""
    member = points.select(*by, "a").join(border, [*by, "a"], "left").join(core, [*by, "a"], "left").select(*by, "a", F.coalesce("root", "near").alias("cluster")).where(F.col("cluster").isNotNull())
    sizes = member.groupBy(*by, "cluster").agg(F.count("*").alias("n")).join(settings, by).where(F.col("n") > F.col("min_pts"))
    kept = member.join(sizes.select(*by, "cluster"), [*by, "cluster"], "left_semi").select(*by, "a", "cluster")
    bare = points.select(*by, "a").join(kept.select(*by).distinct(), by, "left_anti").select(*by, "a", F.lit(2).cast("long").alias("cluster"))
    return kept.select(*by, "a", F.col("cluster").cast("long").alias("cluster")).union(bare)


def label_distance(labels: int, base: float) -> Column:
    """A map-free expression of ``l1, l2``: base to the power of their distance around the circle of labels."""
    apart = F.abs(F.col("l1") - F.col("l2"))
    return F.pow(F.lit(base), F.when(apart > labels // 2, labels - apart).otherwise(apart).cast("double"))


def detrend(values: Column) -> Column:
    """Less the line from the first sample to the last, over the length."""
    n = F.size(values)
    slope = (F.get(values, n - 1).cast("double") - F.get(values, F.lit(0)).cast("double")) / n
    return F.transform(values, lambda v, i: v.cast("double") - slope * i)


def edge_blend(values: Column, share: float) -> Column:
    """The first and last ``share`` of the samples ramp to the midpoint of the two ends, so that a cycle closes."""
    n = F.size(values)
    k = F.floor(n * share).cast("int")
    middle = (F.get(values, F.lit(0)).cast("double") + F.get(values, n - 1).cast("double")) / 2
    near = lambda i: F.least(i, n - 1 - i)
    return F.transform(values, lambda v, i: F.when(near(i) < k, middle + (v.cast("double") - middle) * near(i) / k).otherwise(v.cast("double")))


def arg_last(values: Column, largest: bool) -> Column:
    """The position of the largest (or smallest) sample, the last one of equals."""
    best = F.array_max(values) if largest else F.array_min(values)
    return F.size(values) - F.array_position(F.reverse(values), best).cast("int")


def median_upper(values: Column) -> Column:
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def cell_costs(a: np.ndarray, b: np.ndarray, factor: np.ndarray | None = None, lam: float | None = None) -> np.ndarray:
    """What it costs to lay sample i of each series in ``a`` on sample j of that in ``b``: their distance times ``factor``.

    With ``lam`` (0 or more) the signed difference d costs exp(-d / lam) instead, which is small where ``a`` lies above ``b``.
    """
    cells = a[:, :, None] - b[:, None, :]
    if factor is not None:
        cells = cells * factor
    return np.exp(-cells / lam) if lam is not None and lam >= 0 else np.abs(cells)


def label_factors(la: np.ndarray, lb: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The label distances of all cells; ``table[l1, l2]`` with labels from 0 or 1 on."""
    return table[la[:, :, None], lb[:, None, :]]


def label_table(labels: int, base: float) -> np.ndarray:
    """``label_distance`` as a table for labels 1 to ``labels`` (row and column 0 are those of no label: distance one)."""
    apart = np.abs(np.subtract.outer(np.arange(labels + 1), np.arange(labels + 1)))
    out = base ** np.where(apart > labels // 2, labels - apart, apart).astype(float)
    out[0], out[:, 0] = 1, 1
    return out


def dtw_batch(a: np.ndarray, b: np.ndarray, factor: np.ndarray | None = None, lam: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Accumulated costs and steps (0 diagonal, 1 in a, 2 in b; the diagonal wins ties) of many pairs of series at once."""
    n, m = a.shape[1], b.shape[1]
    cells = cell_costs(a, b, factor, lam).transpose(1, 2, 0)
    cost = np.full((n + 1, m + 1, len(a)), np.inf)
    step = np.zeros((n + 1, m + 1, len(a)), np.uint8)
    cost[0, 0] = 0
    for diagonal in range(n + m - 1):  # its cells depend on the two diagonals before it only
        i = np.arange(max(0, diagonal - m + 1), min(n - 1, diagonal) + 1)
        j = diagonal - i
        d, x, y = cost[i, j], cost[i, j + 1], cost[i + 1, j]
        best = np.minimum(np.minimum(d, x), y)
        step[i + 1, j + 1] = np.where(d <= best, 0, np.where(x <= best, 1, 2))
        cost[i + 1, j + 1] = best + cells[i, j]
    return cost, step


def dtw_total(cells: np.ndarray) -> np.ndarray:
    """The cheapest path's cost through each pair's ``cells[pair, i, j]``, one diagonal at a time."""
    _, n, m = cells.shape
    cells = cells.transpose(1, 2, 0)
    before = now = np.full((n + 1, cells.shape[2]), np.inf)  # row i + 1 is sample i
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n - 1, d) + 1)
        best = np.minimum(np.minimum(before[i], now[i]), now[i + 1]) if d else 0.0
        new = np.full_like(now, np.inf)
        new[i + 1] = cells[i, d - i] + best
        before, now = now, new
    return now[n]


def dtw_cost(pairs: DataFrame, keys: list[str], a: str, b: str, block: int = 256, labels: tuple[str, str] | None = None, table: np.ndarray | None = None, lam: float | None = None) -> DataFrame:
    """``keys, cost``: unconstrained warping cost of two series of one length over length and the root of two; missing samples count 0.

    With ``labels`` (the label columns of both) a cell counts by its labels' distance in ``table``, a small constant.
    """
    extra = list(labels or ())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), block):
                part = pdf.iloc[lo : lo + block]
                x, y = (np.nan_to_num(np.stack(part[c].to_numpy()).astype(np.float64)) for c in (a, b))
                factor = label_factors(*(np.stack(part[c].to_numpy()) for c in extra), table) if extra else None
                yield part[keys].assign(cost=dtw_total(cell_costs(x, y, factor, lam)) / (x.shape[1] * 2**0.5))

    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.select(*keys, a, b, *extra).mapInPandas(run, f"{kinds}, cost double")


def dtw_matrix(series: DataFrame, by: list[str], key: str, values: str, labels: str | None = None, table: np.ndarray | None = None, lam: float | None = None) -> DataFrame:
    """``by, a, b, d``: warping costs of all pairs a < b of a class."""
    columns = {values: ("_x", "_y")} | ({labels: ("_lx", "_ly")} if labels else {})
    rows = pairs_within(series, by, key, columns, 100)
    return dtw_cost(rows, [*by, "a", "b"], "_x", "_y", labels=("_lx", "_ly") if labels else None, table=table, lam=lam).withColumnRenamed("cost", "d")


def barycentres(series: DataFrame, by: str, key: str, values: str, rounds: int = 100) -> DataFrame:
    """``by, frame, value, members``: each class's mean shape under warping.

    The seed is the series whose detrended extremes lie closest to the class's median positions. In a round every series is warped to its
    class's present shape, which a join brings to it, and what falls on each frame is summed within the task; the sums (classes by frames) are
    the next shape. A class is done when its shape has been there before (it settled, or goes round), all are after ``rounds``. Shapes stay in tables, however many classes there are.
    """
    checkpoint_dir(series.sparkSession)
    flat = detrend(F.col(values))
    placed = series.select(by, key, F.transform(values, lambda v: v.cast("double")).alias("x"), arg_last(flat, False).alias("lo"), arg_last(flat, True).alias("hi"))
    middle = placed.groupBy(by).agg(F.median("lo").alias("mlo"), F.median("hi").alias("mhi"), F.count("*").alias("members"))
    seeds = placed.join(middle, by).groupBy(by).agg(F.min_by("x", F.struct(F.abs(F.col("lo") - F.col("mlo")) + F.abs(F.col("hi") - F.col("mhi")), F.col(key))).alias("shape"))
    seen = lambda shape: F.xxhash64(F.transform(shape, lambda v: F.round(v, 9)))
    shapes = seeds.withColumn("_seen", F.array(seen(F.col("shape")))).checkpoint()
    kind = series.schema[by].dataType.simpleString()

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, owner = np.unique(pdf[by].to_numpy(), return_inverse=True)
            s = n = None
            for lo in range(0, len(pdf), 256):
                x, shape = (np.stack(pdf[c].iloc[lo : lo + 256].to_numpy()) for c in ("x", "shape"))
                own = owner[lo : lo + 256]
                if s is None:
                    s, n = np.zeros((len(names), shape.shape[1])), np.zeros((len(names), shape.shape[1]))
                _, step = dtw_batch(shape, x)
                i, j, rows = np.full(len(x), shape.shape[1]), np.full(len(x), x.shape[1]), np.arange(len(x))
                while len(rows):
                    np.add.at(s, (own[rows], i[rows] - 1), x[rows, j[rows] - 1])
                    np.add.at(n, (own[rows], i[rows] - 1), 1)
                    way = step[i[rows], j[rows], rows]
                    i[rows] -= way != 2
                    j[rows] -= way != 1
                    rows = rows[(i[rows] > 0) & (j[rows] > 0)]
            if s is not None:
                frames = s.shape[1]
                yield pd.DataFrame({by: np.repeat(names, frames), "frame": np.tile(np.arange(frames, dtype=np.int32), len(names)), "s": s.ravel(), "n": n.ravel()})

    moving, send = shapes.select(by), sender(shapes)
    for _ in range(rounds):
        met = placed.select(by, "x").join(send(shapes.select(by, "shape").join(moving, by, "left_semi")), by)
        found = met.mapInPandas(sums, f"{by} {kind}, frame int, s double, n double").groupBy(by, "frame").agg((F.sum("s") / F.sum("n")).alias("v"))
        new = found.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("frame", "v"))).alias("p")).select(by, F.transform("p", lambda q: q["v"]).alias("next"))
        fresh = F.col("next").isNotNull() & ~F.array_contains("_seen", seen(F.col("next")))
        both = shapes.join(new, by, "left").select(by, F.coalesce("next", "shape").alias("shape"), fresh.alias("_moved"), F.when(fresh, F.array_append("_seen", seen(F.col("next")))).otherwise(F.col("_seen")).alias("_seen")).checkpoint()
        shapes, moving = both.drop("_moved"), both.where("_moved").select(by)  # classes that have settled are left alone
        if moving.isEmpty():
            break
    return shapes.join(middle.select(by, "members"), by).select(by, F.posexplode("shape").alias("frame", "value"), "members")


def natural_spline(y: np.ndarray, linear: bool = False) -> np.ndarray:
    """Missing (NaN) samples of each row on the natural cubic spline through its others (or on the ``linear`` one); outside them the end's straight line.

    Rows with fewer than two other samples are unchanged. Rows that miss the same samples are solved together.
    """
    rows = np.atleast_2d(y)
    out = rows.copy()
    masks, which = np.unique(np.isnan(rows), axis=0, return_inverse=True)
    for k, mask in enumerate(masks):
        known = np.flatnonzero(~mask)
        if len(known) < 2 or not mask.any():
            continue
        mine = np.flatnonzero(which.ravel() == k)
        h, v = np.diff(known).astype(float), rows[mine][:, known]
        n, slope = len(known), np.diff(v, axis=1) / h
        curve = np.zeros(v.shape)
        if n > 2 and not linear:
            main, right = 2 * (h[:-1] + h[1:]), 6 * np.diff(slope, axis=1)
            for i in range(1, n - 2):  # tridiagonal elimination
                f = h[i] / main[i - 1]
                main[i] -= f * h[i]
                right[:, i] -= f * right[:, i - 1]
            for i in range(n - 3, -1, -1):
                curve[:, i + 1] = (right[:, i] - (h[i + 1] * curve[:, i + 2] if i < n - 3 else 0)) / main[i]
        at = np.flatnonzero(mask)
        left = np.clip(np.searchsorted(known, at) - 1, 0, n - 2)
        w, x = h[left], at - known[left]
        inner = v[:, left] + x * (slope[:, left] - w * (2 * curve[:, left] + curve[:, left + 1]) / 6) + x**2 * curve[:, left] / 2 + x**3 * (curve[:, left + 1] - curve[:, left]) / (6 * w)
        first, last = slope[:, :1] - h[0] * curve[:, 1:2] / 6, slope[:, -1:] + h[-1] * curve[:, -2:-1] / 6
        inner = np.where(at < known[0], v[:, :1] + (at - known[0]) * first, inner)
        out[np.ix_(mine, at)] = np.where(at > known[-1], v[:, -1:] + (at - known[-1]) * last, inner)
    return out.reshape(y.shape)


def fill_series(series: DataFrame, keys: list[str], values: str, linear: bool = False) -> DataFrame:
    """``keys, filled``: arrays of one length with their missing samples (null or NaN) filled by ``natural_spline``, a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf[keys].assign(filled=list(natural_spline(np.stack([np.array(v, dtype=np.float64) for v in pdf[values]]), linear)))

    kinds = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)
    return series.select(*keys, F.transform(values, lambda v: v.cast("double")).alias(values)).mapInPandas(run, f"{kinds}, filled array<double>")


def persistence(y: np.ndarray) -> list[tuple[int, int, float]]:
    """``(minimum, maximum, persistence)``: each merged valley with the peak at which it meets an older (lower) one. Ties go by position."""
    n = len(y)
    root = [-1] * n
    low: dict[int, int] = {}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    pairs = []
    for i in sorted(range(n), key=lambda k: (y[k], k)):
        near = sorted({find(j) for j in (i - 1, i + 1) if 0 <= j < n and root[j] >= 0}, key=lambda r: (y[low[r]], low[r]))
        if not near:
            root[i], low[i] = i, i
        else:
            root[i] = near[0]
            for r in near[1:]:
                pairs.append((low[r], i, float(y[i] - y[low[r]])))
                root[r] = near[0]
    return sorted(pairs)


def lowest(values: Column) -> Column:
    """The position of the global minimum, the first of equals: the one valley that ``persistence`` never pairs."""
    return F.array_position(values, F.array_min(values)).cast("int") - 1


#: Persistences below this never count.
FAINT = 1e-4


def events_of(y: np.ndarray, border: bool = True) -> list[int]:
    """``persistent_events`` of one series: their positions."""
    found = persistence(y)
    heights = sorted(p for *_, p in found if p >= FAINT)
    if not heights:
        return []
    middle, last = heights[len(heights) // 2], len(y) - 1
    kept = [(lo, hi) for lo, hi, p in found if p > middle and not (border and ({lo, hi} & {0, last}))]
    return sorted({i for pair in kept for i in pair})


def persistent_events(series: DataFrame, keys: list[str], values: str, border: bool = True) -> DataFrame:
    """``keys, pos, value``: minima and maxima of a series that are more persistent than its middle persistence.

    Persistences below ``FAINT`` are left out of the middle (the upper one of an even number); extrema whose pair touches an end of the series are
    dropped unless ``border`` is false.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                y = np.asarray(row[-1], dtype=np.float64)
                out += [(*row[:-1], i, float(y[i])) for i in events_of(y, border)]
            yield pd.DataFrame(out, columns=[*keys, "pos", "value"])

    kinds = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)
    return series.select(*keys, values).mapInPandas(run, f"{kinds}, pos int, value double")
