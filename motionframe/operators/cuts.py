"""The best cut of sorted values for many questions about their classes at once, without sorting them all.

Values are counted by bins of their group's range. What a cut inside a bin can reach at most follows from the counts before and in the bin: the
quality is convex in the counts left of the cut, so it is largest at a corner of the box between the two. Only bins that may hold a better cut
than the best one between bins are looked into: counted again by finer bins while they are large, then sorted. All counts are exact, and nothing depends on how
rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Neighbouring values are cut between if they are further apart than this.
GAP = 2 * 1.1920929e-07

#: Bins of an interval, rows of one that are sorted in one task, tables of at most so many rows that are sent to every task, classes whose corners are tried (more: every bin is looked into).
BINS, FEW, SENT, CORNERS = 512, 65_536, 100_000, 10

#: Neighbouring intervals of a group that are judged in one task at once.
PART = 32

#: Levels of bins after which what is left may be more than a tenth, and after which it may be any size.
FINE, FINEST = 3, 8


def _score(counts: np.ndarray) -> np.ndarray:
    """Sum of squares over the sum; 0 of nothing."""
    whole = counts.sum(axis=-1)
    return np.divide((counts * counts).sum(axis=-1), whole, out=np.zeros(whole.shape), where=whole > 0)


def reach(a: np.ndarray, b: np.ndarray, total: np.ndarray) -> np.ndarray:
    """What a cut with counts between ``a`` and ``b`` (rows x classes) left of it can reach at most."""
    count = a.shape[1]
    if count > CORNERS:
        return np.full(len(a), np.inf)
    corners = (np.arange(1 << count)[:, None] >> np.arange(count) & 1).astype(float)
    out = np.empty(len(a))
    for lo in range(0, len(a), 256):
        p, q = a[lo : lo + 256], b[lo : lo + 256]
        best = 0.0
        for x, y in ((p, q), (total - p, total - q)):
            one, two = x.sum(axis=1)[:, None] + (y - x) @ corners.T, (x * x).sum(axis=1)[:, None] + (y * y - x * x) @ corners.T
            best = best + np.divide(two, one, out=np.zeros(one.shape), where=one > 0)
        out[lo : lo + 256] = best.max(axis=1)
    return out


def _told(threshold: np.ndarray, quality: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the cuts that may be best when rounded, the one of least threshold for each quality."""
    near = quality >= quality.max() - 2e-9
    threshold, quality = threshold[near], quality[near]
    order = np.lexsort((threshold, quality))
    first = np.r_[True, np.diff(quality[order]) != 0]
    return threshold[order][first], quality[order][first]


def best_cuts(long: DataFrame, by: list[str], x: str, label: str, labels: list, questions: list[tuple[int, list[int]]], weights: list[str] | None = None, bins: int = BINS, few: int = FEW) -> DataFrame:
    """``by, question, threshold, quality``: for each of ``questions`` the cut of a group's values that maximises sum L_c^2 / L + sum R_c^2 / R over its classes; ties go to the smaller threshold.

    A question names one of the columns ``weights`` (None: every row counts one) and classes by their place in ``labels``; rows of other classes or without weight are not
    there for it. Missing values take no part. A question without a cut has no row.
    """
    spark = long.sparkSession
    checkpoint_dir(spark)
    count, kinds = len(labels), ", ".join(f"{c} {long.schema[c].dataType.simpleString()}" for c in by)
    sizes = [F.col(w).cast("double") for w in weights] if weights else [F.lit(1.0)]
    w = [f"_w{i}" for i in range(len(sizes))]
    place = F.coalesce(*[F.when(F.col(label) == v, F.lit(i)) for i, v in enumerate(labels)])
    known = long.where(F.col(x).isNotNull() & ~F.isnan(x)).select(*by, F.col(x).cast("double").alias("_x"), place.alias("_c"), *[s.alias(n) for n, s in zip(w, sizes)])
    known = known.where(F.col("_c").isNotNull() & (F.greatest(*w, F.lit(0.0)) > 0))
    finite = F.when(F.abs("_x") < float("inf"), F.col("_x"))
    every = list(range(len(questions)))

    ends = known.groupBy(*by, "_c").agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.count("*").alias("n"), F.array(*[F.sum(c) for c in w]).alias("t"))
    totals = F.array(*[F.coalesce(F.max(F.when(F.col("_c") == c, F.get("t", F.lit(i)))), F.lit(0.0)) for i in range(len(w)) for c in range(count)])
    state = ends.groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").cast("double").alias("n"), totals.alias("t"))
    nothing = F.array(*[F.lit(0.0)] * (len(w) * count))
    state = state.select(*by, F.lit(0).cast("long").alias("_s"), "lo", "hi", "n", nothing.alias("p"), "t", F.array(*[F.lit(-1.0)] * len(every)).alias("best"), F.array(*map(F.lit, every)).alias("live")).checkpoint()

    def judge(pdf: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """The cuts between bins of some of one group's intervals (``held``, in any order) that may be best, and the bins to be looked into."""
        if not len(pdf) or not len(held):
            return pd.DataFrame(columns=[*by, *columns])
        mine, held = held[by].iloc[:1], held.sort_values("_s")
        places, row = np.unique(pdf["_s"].to_numpy() * bins + pdf["_bin"].to_numpy(), return_inverse=True)
        shape, at = (len(places), len(w), count), pdf["_c"].to_numpy()
        n, first, last = np.zeros(shape), np.full(shape, np.inf), np.full(shape, -np.inf)
        for i in range(len(w)):
            n[row, i, at] = pdf[f"n{i}"].to_numpy(float)
            for out, c in ((first, "a"), (last, "z")):
                v = pdf[f"{c}{i}"].to_numpy(float)
                out[row[~np.isnan(v)], i, at[~np.isnan(v)]] = v[~np.isnan(v)]
        lo, hi, rows = np.full(len(places), np.inf), np.full(len(places), -np.inf), np.zeros(len(places))
        np.minimum.at(lo, row, pdf["lo"].to_numpy(float, na_value=np.inf))
        np.maximum.at(hi, row, pdf["hi"].to_numpy(float, na_value=-np.inf))
        np.add.at(rows, row, pdf["n"].to_numpy(float))
        owner = places // bins
        parent = np.searchsorted(held["_s"].to_numpy(), owner)
        start = np.stack(held["p"].to_numpy()).reshape(-1, len(w), count)[parent]
        total, best = np.asarray(held["t"].iloc[0], float).reshape(len(w), count), np.stack(held["best"].to_numpy()).max(axis=0)
        asked = np.zeros((len(held), len(every)), bool)
        for k, m in enumerate(held["live"]):
            asked[k, np.asarray(m, int)] = True
        live = asked[parent]
        run = np.cumsum(n, axis=0) - n
        before = start + run - run[np.searchsorted(owner, owner)]
        found, wanted = [], np.zeros(live.shape, bool)
        for m, (i, classes) in enumerate(questions):
            here = np.flatnonzero((n[:, i, classes].sum(axis=1) > 0) & live[:, m])
            if not len(here):
                continue
            a, own, whole = before[here][:, i, classes], n[here][:, i, classes], total[i, classes]
            low, high = first[here][:, i, classes].min(axis=1), last[here][:, i, classes].max(axis=1)
            cut = np.flatnonzero((owner[here[1:]] == owner[here[:-1]]) & (low[1:] > high[:-1] + GAP))
            inner = low + GAP < high
            if len(cut):
                left = (a + own)[cut]
                quality, threshold = _score(left) + _score(whole - left), (high[cut] + low[cut + 1]) / 2
                found += [(m, t, q) for t, q in zip(*_told(threshold, quality))]
                best[m] = max(best[m], quality.max())
            if (whole > 0).sum() < 2:  # every cut is as good: the first one wins
                inner &= np.arange(len(here)) <= (cut[0] if len(cut) else len(here))
            else:
                inner[inner] = reach(a[inner], (a + own)[inner], whole) * (1 + 1e-12) + 4e-9 >= best[m]
            wanted[here[inner], m] = True
        deep = np.flatnonzero(wanted.any(axis=1))
        k, d = len(found), len(deep)
        lists = {"p": list(before[deep].reshape(d, len(w) * count)), "t": [total.ravel()] * d, "best": [best] * d, "live": [np.flatnonzero(v).astype(np.int32) for v in wanted[deep]]}
        numbers = {"lo": lo[deep], "hi": hi[deep], "n": rows[deep]}
        out = pd.DataFrame({c: [mine[c].iloc[0]] * (k + d) for c in by})
        out["question"] = np.r_[np.array([f[0] for f in found], np.int32), np.full(d, -1, np.int32)]
        for i, c in enumerate(("threshold", "quality"), 1):
            out[c] = np.r_[np.array([f[i] for f in found], float), np.full(d, np.nan)]
        out["_s"] = np.r_[np.full(k, -1), places[deep]]
        for c, v in numbers.items():
            out[c] = np.r_[np.full(k, np.nan), v]
        for c, v in lists.items():
            out[c] = pd.Series([None] * k + v, dtype=object)
        return out[[*by, *columns]]

    columns = ["question", "threshold", "quality", "_s", "lo", "hi", "n", "p", "t", "best", "live"]
    form = f"{kinds}, question int, threshold double, quality double, _s long, lo double, hi double, n double, p array<double>, t array<double>, best array<double>, live array<int>"

    def bin_of(lo: Column, hi: Column) -> Column:  # rises with the value, whatever is rounded
        share = (F.col("_x") / 2 - lo / 2) / F.nullif(hi / 2 - lo / 2, F.lit(0.0)) * bins
        return F.coalesce(F.floor(F.greatest(F.least(share, F.lit(bins - 1.0)), F.lit(0.0))), F.lit(0)).cast("long")

    def located(chain: list[tuple[DataFrame, int]], last: bool = False) -> DataFrame:
        """The rows with the interval ``_s`` that they lie in, after all levels of bins; with ``last`` its parent's and the place ``_bin`` there."""
        rows = known.withColumn("_s", F.lit(0).cast("long"))
        for k, (level, size) in enumerate(chain):
            level = level.select(*by, "_s", "lo", "hi")
            rows = rows.join(F.broadcast(level) if size <= SENT else level, [*by, "_s"]).withColumn("_bin", bin_of(F.col("lo"), F.col("hi")))
            rows = rows.drop("lo", "hi") if last and k == len(chain) - 1 else rows.withColumn("_s", F.col("_s") * bins + F.col("_bin")).drop("lo", "hi", "_bin")
        return rows

    told: list[DataFrame] = []
    chain: list[tuple[DataFrame, int]] = []
    all_rows = None
    while True:
        split = F.when((F.col("hi") / 2 - F.col("lo") / 2) > 0, F.col("n"))
        size, largest, left = state.agg(F.count("*"), F.max(split), F.sum("n")).first()
        all_rows = left if all_rows is None else all_rows
        if not size or ((largest or 0) <= few and (not chain or left <= all_rows / 10 or len(chain) >= FINE)) or len(chain) == FINEST:
            break
        chain.append((state, size))
        counted = located(chain, True).groupBy(*by, "_s", "_bin", "_c").agg(
            F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.count("*").cast("double").alias("n"), *[F.sum(c).alias(f"n{i}") for i, c in enumerate(w)],
            *[f(F.when(F.col(c) > 0, F.col("_x"))).alias(f"{name}{i}") for i, c in enumerate(w) for f, name in ((F.min, "a"), (F.max, "z"))],
        )
        part = F.floor(F.col("_s") / PART).alias("_part")  # what a task holds at once does not grow with a group
        counted, facts = counted.select("*", part), state.select(*[F.col(c).alias(c) for c in [*by, "_s", "p", "t", "best", "live"]], part)  # columns of their own
        judged = counted.groupBy(*by, "_part").cogroup(facts.groupBy(*by, "_part")).applyInPandas(judge, form).checkpoint()
        told.append(judged.where("question >= 0").select(*by, "question", "threshold", "quality"))
        state = judged.where("question < 0").drop("question", "threshold", "quality")

    rows = located(chain)
    if chain:
        kept = state.select(*by, "_s")
        rows = rows.join(F.broadcast(kept) if size <= SENT else kept, [*by, "_s"])
    width = max(len(c) for _, c in questions)
    slot = lambda m, k: F.lit(questions[m][0] * count + questions[m][1][k]) if k < len(questions[m][1]) else F.lit(-1)
    slots = F.array(*[F.array(*[slot(m, k) for k in range(width)]) for m in every])
    facts = state.select(*by, "_s", F.explode("live").alias("question"), "p", "t").withColumn("_slots", F.get(slots, F.col("question")))
    value = lambda c, k: F.when(F.get("_slots", F.lit(k)) >= 0, F.get(c, F.get("_slots", F.lit(k)))).otherwise(0.0)
    facts = facts.select(*by, "_s", "question", "_slots", *[value(c, k).alias(f"{c}{k}") for c in ("p", "t") for k in range(width)])
    table = lambda rows: F.array(*[F.array(*map(F.lit, r)) for r in rows])
    own = F.get(table([[m for m in every if c in questions[m][1]] or [-1] for c in range(count)]), F.col("_c"))  # the questions that a class is in
    if chain and len(every) > 1:
        live = state.select(*by, "_s", "live")
        rows = rows.join(F.broadcast(live) if size * len(every) <= SENT else live, [*by, "_s"])
        own = F.array_intersect(own, F.col("live"))
    posed = rows.select("*", F.explode(own).alias("question")).where("question >= 0")
    slot_of = table([[questions[m][1].index(c) + 1 if c in questions[m][1] else 0 for c in range(count)] for m in every])
    posed = posed.withColumns({"k": F.get(F.get(slot_of, F.col("question")), F.col("_c")), "w": F.get(F.array(*w), F.get(F.array(*[F.lit(i) for i, _ in questions]), F.col("question")))})
    values = posed.where("k > 0 AND w > 0").groupBy(*by, "_s", "question", "_x").agg(*[F.sum(F.when(F.col("k") == k + 1, F.col("w")).otherwise(0.0)).alias(f"n{k}") for k in range(width)])
    inside = Window.partitionBy(*by, "_s", "question").orderBy("_x")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    running = values.select(*by, "_s", "question", "_x", F.lead("_x").over(inside).alias("_next"), *[F.sum(f"n{k}").over(upto).alias(f"r{k}") for k in range(width)])
    scan = running.where(F.col("_next") > F.col("_x") + GAP).join(facts, [*by, "_s", "question"])
    before = [F.col(f"r{k}") + F.col(f"p{k}") for k in range(width)]
    after = [F.col(f"t{k}") - b for k, b in enumerate(before)]
    score = lambda counts: sum(c * c for c in counts) / F.nullif(sum(counts), F.lit(0.0))
    cuts = scan.select(*by, "question", ((F.col("_x") + F.col("_next")) / 2).alias("threshold"), (score(before) + score(after)).alias("quality"))
    for other in told:
        cuts = cuts.union(other)
    return cuts.groupBy(*by, "question").agg(F.min_by("threshold", F.struct(-F.round("quality", 9), F.col("threshold"))).alias("threshold"), F.max("quality").alias("quality"))


def pairs_of(labels: list) -> Iterator[tuple[int, int]]:
    """The places of every two of ``labels``."""
    return ((i, j) for i in range(len(labels)) for j in range(i + 1, len(labels)))


def pair_cuts(long: DataFrame, by: list[str], x: str, label: str, labels: list, weights: list[str] | None = None, bins: int = BINS, few: int = FEW) -> DataFrame:
    """``by, weight, l1, l2, threshold, quality``: ``best_cuts`` between every two of ``labels`` (ascending ints), by each of ``weights`` (their place)."""
    asked = [(i, p, q) for i in range(len(weights or [None])) for p, q in pairs_of(labels)]
    if not asked:
        return long.select(*by, *[F.lit(0).alias(c) for c in ("weight", "l1", "l2")], *[F.lit(0.0).alias(c) for c in ("threshold", "quality")]).limit(0)
    found = best_cuts(long, by, x, label, labels, [(i, [p, q]) for i, p, q in asked], weights, bins, few)
    names = F.array(*[F.struct(F.lit(i).alias("weight"), F.lit(labels[p]).alias("l1"), F.lit(labels[q]).alias("l2")) for i, p, q in asked])
    return found.withColumn("_q", F.get(names, F.col("question"))).select(*by, "_q.weight", "_q.l1", "_q.l2", "threshold", "quality")
