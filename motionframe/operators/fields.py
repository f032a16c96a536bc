"""Sparse units over pairs of frames, and their search in random subspaces of channels.

A unit is a logistic model of left less right channels whose L1 penalty is laid on as a running total: a factor is never cut by more than it
still owes, so most end at exactly zero. Its cut is found anew before every epoch by the class-count scan over the samples' values.
All units of one pair of frames are fitted side by side, one numpy row each, on the pair's bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Unit:
    """How units are fitted: epochs whose mean sparsity must settle, step, most epochs, penalty per step, and how little the mean may still move.

    ``rows`` bounds the sample that a pair of frames is fitted to: those of smallest hash of their key, the same for all pairs.
    """

    stability: int = 50
    rate: float = 0.02
    epochs: int = 2000
    penalty: float = 1e-4
    settled: float = 5e-4
    rows: int = 2000


def best_cut(values: np.ndarray, labels: np.ndarray, classes: int) -> tuple[float, float] | None:
    """``cut, quality`` of the best split of ``values``: the sum over both sides of squared class counts over the side's size; the first of equals.

    Values closer than 1e-4 are not parted. None where all are that close. ``labels`` are numbers from 0.
    """
    order = np.argsort(values, kind="stable")
    v = values[order]
    left = np.cumsum(np.eye(classes)[labels[order]], axis=0)
    right = left[-1] - left
    n = np.arange(1, len(v))
    quality = np.where(v[:-1] + 1e-4 < v[1:], (left[:-1] ** 2).sum(axis=1) / n + (right[:-1] ** 2).sum(axis=1) / (len(v) - n), 0.0)
    if not len(quality) or quality.max() <= 0:
        return None
    at = int(quality.argmax())
    return (v[at] + v[at + 1]) * 0.5, float(quality[at])


def positive_class(above: np.ndarray, labels: np.ndarray, classes: int) -> int:
    """The class whose samples should come out at 1: the most frequent one below the cut (the smallest of equals).

    Where one class leads on both sides it is left out on the side that has less of it (above, if equal), until the leaders differ; -1 when a side runs out.
    """
    low, high = (np.bincount(labels[side], minlength=classes).astype(float) for side in (~above, above))
    while np.isfinite(low).any() and np.isfinite(high).any():
        a, b = int(low.argmax()), int(high.argmax())
        if a != b:
            return a
        (low if low[a] < high[b] else high)[a] = -np.inf
    return -1


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def fit_units(apart: np.ndarray, labels: np.ndarray, subsets: np.ndarray, settings: Unit, seed: int) -> list[tuple[np.ndarray, float, float, float]]:
    """``factors, sparsity, cut, quality`` of one unit per row of ``subsets`` (columns of ``apart``). Sample order is drawn per epoch from ``seed``.

    An update goes along the gradient, then every factor is drawn to zero by what the running penalty exceeds what it has paid; one that leaves [-1, 1] starts
    again at zero. Fitting ends when the share of non-zero factors, as a mean over ``stability`` epochs, settles.
    """
    names, y = np.unique(labels, return_inverse=True)
    x = apart[:, subsets]  # samples x units x channels
    units, k = subsets.shape
    w, paid = np.ones((units, k)), np.zeros((units, k))
    cut, quality = np.full(units, 0.5), np.zeros(units)
    shares: list[np.ndarray] = []
    before, total = np.ones(units), 0.0
    live, out = np.arange(units), [None] * units
    draw = np.random.default_rng(seed)
    for epoch in range(settings.epochs + 1):
        values = _logistic((x * w).sum(axis=2))
        positive = np.empty(len(live), int)
        for u in range(len(live)):
            found = best_cut(values[:, u], y, len(names))
            if found:
                cut[u], quality[u] = found
            positive[u] = positive_class(values[:, u] > cut[u], y, len(names))
        for i in draw.permutation(len(x)):
            total += settings.penalty * settings.rate
            row = x[i]
            w += settings.rate * ((positive == y[i]) - _logistic((row * w).sum(axis=1)))[:, None] * row
            z = w.copy()
            w = np.where(z > 0, np.maximum(0.0, z - (total + paid)), np.where(z < 0, np.minimum(0.0, z + (total - paid)), 0.0))
            w[np.abs(w) > 1] = 0.0
            paid += w - z
        share = (np.abs(w) > 1e-6).mean(axis=1)
        shares = [*shares, share][-settings.stability :]
        done = np.full(len(live), epoch == settings.epochs)
        if epoch >= settings.stability:
            mean = np.mean(shares, axis=0)
            done |= np.abs(mean - before) < settings.settled
            before = mean
        for u in np.flatnonzero(done):
            out[live[u]] = (w[u].copy(), float(share[u]), float(cut[u]), float(quality[u]))
        if done.all():
            break
        if done.any():
            go = ~done
            live, x, w, paid, cut, quality, before, shares = live[go], x[:, go], w[go], paid[go], cut[go], quality[go], before[go], [s[go] for s in shares]
    return out


def subspaces(channels: int, branches: int, seed: int) -> np.ndarray:
    """``branches`` random sets of as many channels as the root of their number (two at least, if there are two)."""
    k = max(2, int(channels**0.5)) if channels > 1 else 1
    return np.stack([np.random.default_rng([seed, b]).permutation(channels)[:k] for b in range(branches)])


#: Tasks that pairs of frames are dealt to at most.
MOST_TASKS = 10_000
#: What a search gives and ``reduce_candidates`` and ``apply_field_table`` take.
CANDIDATES = "a int, b int, branch int, indices array<int>, factors array<double>, sparsity double, split double, quality double"


def search_fields(rows: DataFrame, key: str, label: str, frames: str, pairs: list[tuple[int, int]], branches: int = 10, settings: Unit = Unit(), seed: int = 0) -> DataFrame:
    """``CANDIDATES``: for each pair of frames a unit per random subspace of channels, those that keep enough channels and part the classes.

    ``frames`` is an array of frames, each an array of channels; missing channels count 0, null frames and labels take no part. Only the bounded sample (``Unit.rows``)
    is dealt, once per pair; all units of a pair are fitted in one task, so no group is larger than that bound. A unit passes when more than half
    a channel's share of its factors is not zero and its quality is above zero. An empty table gives no rows.
    """
    kept = rows.where(F.col(label).isNotNull() & F.col(frames).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("string").alias("label"), F.col(frames).alias("frames"))
    sample = kept.orderBy(F.xxhash64("_key"), "_key").limit(settings.rows)
    at = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]))
    known = lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0))
    dealt = sample.withColumn("p", at).select("_key", "label", "p.a", "p.b", F.zip_with(F.get("frames", F.col("p.a")), F.get("frames", F.col("p.b")), lambda x, y: known(x) - known(y)).alias("apart"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_key", kind="stable")
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        apart = np.stack(pdf["apart"].to_numpy()).astype(float)
        sets = subspaces(apart.shape[1], branches, seed + 1_000_003 * a + b)
        found = fit_units(apart, pdf["label"].to_numpy(), sets, settings, seed + 1_000_003 * a + b)
        out = [(a, b, i, s.tolist(), w.tolist(), share, cut, q) for i, (s, (w, share, cut, q)) in enumerate(zip(sets, found)) if share > 0.5 / len(s) and q > 0]
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in CANDIDATES.split(", ")])

    spread = dealt.where("apart IS NOT NULL").repartition(min(len(pairs), MOST_TASKS), "a", "b")  # few rows, much work: not to be put together again
    return spread.groupBy("a", "b").applyInPandas(fit, CANDIDATES)


def unit_factors(rows: DataFrame, key: str, label: str, left: str, right: str, settings: Unit = Unit(), seed: int = 0) -> DataFrame:
    """``position, factor, split, quality``: the factors that one unit over all channels keeps, on the bounded sample."""
    known = lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0))
    apart = F.zip_with(left, right, lambda x, y: known(x) - known(y))
    kept = rows.where(F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("string").alias("label"), apart.alias("apart")).where("apart IS NOT NULL")
    sample = kept.orderBy(F.xxhash64("_key"), "_key").limit(settings.rows)

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values("_key", kind="stable")
        if len(pdf):
            apart = np.stack(pdf["apart"].to_numpy()).astype(float)
            w, _, cut, q = fit_units(apart, pdf["label"].to_numpy(), np.arange(apart.shape[1])[None], settings, seed)[0]
            at = np.flatnonzero(np.abs(w) > 1e-6)
            yield pd.DataFrame({"position": at.astype(np.int32), "factor": w[at], "split": cut, "quality": q})

    return sample.coalesce(1).mapInPandas(fit, "position int, factor double, split double, quality double")
