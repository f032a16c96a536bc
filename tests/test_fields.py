"""Sparse units and their search against plain loops; candidate tables on disk."""

import math

import numpy as np
import pytest

from motionframe.operators import fields, pairs
from motionframe.plans import clustering
from tests.conftest import SF


def plain_cut(values, labels):
    order = sorted(range(len(values)), key=lambda i: values[i])
    best = (0.0, None)
    for cut in range(len(order) - 1):
        if values[order[cut]] + 1e-4 < values[order[cut + 1]]:
            sides = [[labels[i] for i in order[: cut + 1]], [labels[i] for i in order[cut + 1 :]]]
            quality = sum(sum(side.count(c) ** 2 for c in set(side)) / len(side) for side in sides)
            if quality > best[0] + 1e-9:
                best = (quality, (values[order[cut]] + values[order[cut + 1]]) / 2)
    return best


def plain_unit(apart, labels, chosen, settings, seed):
    names = sorted(set(labels))
    y = [names.index(c) for c in labels]
    w, paid = [1.0] * len(chosen), [0.0] * len(chosen)
    cut, quality, before, total, shares = 0.5, 0.0, 1.0, 0.0, []
    draw = np.random.default_rng(seed)
    squash = lambda row: 1 / (1 + math.exp(-sum(row[c] * f for c, f in zip(chosen, w))))
    for epoch in range(settings.epochs + 1):
        values = [squash(row) for row in apart]
        found = plain_cut(values, y)
        if found[1] is not None:
            quality, cut = found
        counts = [[sum(c == k and (v > cut) == side for c, v in zip(y, values)) for k in range(len(names))] for side in (False, True)]
        positive = -1
        while max(counts[0]) >= 0 and max(counts[1]) >= 0:
            a, b = (c.index(max(c)) for c in counts)
            if a != b:
                positive = a
                break
            counts[0 if counts[0][a] < counts[1][a] else 1][a] = -1
        for i in draw.permutation(len(apart)):
            total += settings.penalty * settings.rate
            error = (1.0 if y[i] == positive else 0.0) - squash(apart[i])
            for j, c in enumerate(chosen):
                z = w[j] + settings.rate * error * apart[i][c]
                w[j] = max(0.0, z - (total + paid[j])) if z > 0 else min(0.0, z + (total - paid[j])) if z < 0 else 0.0
                if abs(w[j]) > 1:
                    w[j] = 0.0
                paid[j] += w[j] - z
        shares = [*shares, sum(abs(f) > 1e-6 for f in w) / len(w)][-settings.stability :]
        if epoch >= settings.stability:
            mean = sum(shares) / len(shares)
            if abs(mean - before) < settings.settled:
                break
            before = mean
    return w, shares[-1], cut, quality


@pytest.mark.parametrize("seed", range(4))
def test_units_against_plain_loops(seed):
    rng = np.random.default_rng(seed)
    labels = rng.integers(0, 3, 60).astype(str)
    apart = rng.normal(size=(60, 5)) + 2 * (labels == "1")[:, None] * np.array([1, 0, -1, 0, 0.5])
    subsets = np.array([[0, 2], [1, 3], [3, 4], [2, 0]])
    settings = fields.Unit(stability=4, epochs=12, penalty=0.02)
    found = fields.fit_units(apart, labels, subsets, settings, seed)
    for chosen, (w, share, cut, quality) in zip(subsets, found):
        plain = plain_unit(apart.tolist(), labels.tolist(), chosen.tolist(), settings, seed)
        assert w == pytest.approx(plain[0], abs=1e-9) and (share, cut, quality) == pytest.approx(plain[1:], abs=1e-9)
    assert any((w == 0).any() for w, *_ in found) and any((w != 0).any() for w, *_ in found)
    alone = fields.fit_units(apart, labels, subsets[1:2], settings, seed)[0]
    assert alone[0] == pytest.approx(found[1][0], abs=1e-12)  # units do not touch each other


def test_positive_class():
    y = np.array([0, 0, 0, 1, 1, 0, 0, 2])
    assert fields.positive_class(np.array([0, 0, 0, 0, 1, 1, 1, 1], bool), y, 3) == 0  # leads below, and above by less: left out there
    assert fields.positive_class(np.zeros(8, bool), y, 3) >= -1 and fields.positive_class(np.array([1] * 8, bool), np.zeros(8, int), 1) == -1
    assert fields.best_cut(np.ones(5), np.zeros(5, int), 1) is None and fields.best_cut(np.ones(1), np.zeros(1, int), 1) is None


def test_units_find_the_channels_that_matter():
    rng = np.random.default_rng(7)
    labels = rng.integers(0, 2, 400)
    apart = rng.normal(0, 0.3, size=(400, 12))
    apart[:, 3] += np.where(labels == 1, 0.3, -0.3)
    w, share, _, quality = fields.fit_units(apart, labels, np.arange(12)[None], fields.Unit(stability=10, epochs=60, penalty=1e-3), 0)[0]
    assert np.flatnonzero(w).tolist() == [3] and share == 1 / 12 and quality > 300


def test_search_of_two_pairs(spark):
    frames = clustering._framed(spark, SF).where("vec_id % 3 = 0")
    settings = fields.Unit(stability=3, epochs=6, rows=90, penalty=5e-3)
    found = {(r.a, r.b, r.branch): r for r in fields.search_fields(frames, "vec_id", "label", "frames", [(0, 3), (5, 2)], 6, settings).collect()}
    chosen = frames.selectExpr("vec_id", "label", "frames", "xxhash64(vec_id) AS h").orderBy("h", "vec_id").limit(90).toPandas().sort_values("vec_id")
    expected = {}
    for a, b in ((0, 3), (5, 2)):
        apart = np.array([np.array(f[a], float) - np.array(f[b], float) for f in chosen["frames"]])
        for i, subset in enumerate(fields.subspaces(8, 6, 1_000_003 * a + b)):
            w, share, cut, quality = plain_unit(apart.tolist(), chosen["label"].astype(str).tolist(), subset.tolist(), settings, 1_000_003 * a + b)
            if share > 0.25 and quality > 0:
                expected[a, b, i] = (subset.tolist(), w, share, cut, quality)
    assert set(found) == set(expected) and expected
    for k, (subset, w, share, cut, quality) in expected.items():
        r = found[k]
        assert r.indices == subset and r.factors == pytest.approx(w, abs=1e-9) and (r.sparsity, r.split, r.quality) == pytest.approx((share, cut, quality), abs=1e-9)
    assert fields.search_fields(frames.limit(0), "vec_id", "label", "frames", [(0, 1)]).count() == 0
    left = pairs.reduce_candidates(spark.createDataFrame([(i, *k[:2], v[0], v[4]) for i, (k, v) in enumerate(expected.items())], "id int, a int, b int, indices array<int>, quality double"), "id", "a", "b", "indices", "quality", 0.5)
    assert 0 < left.count() <= len(expected)


def test_one_unit_over_all_channels(spark):
    rows = clustering._series(spark, SF).selectExpr("vec_id", "label", "slice(embedding, 1, 5) AS x", "slice(embedding, 33, 5) AS y")
    settings = fields.Unit(stability=3, epochs=5, penalty=5e-3)
    table = rows.toPandas().sort_values("vec_id")
    apart = [[float(p) - float(q) for p, q in zip(x, y)] for x, y in zip(table["x"], table["y"])]
    w, _, cut, quality = plain_unit(apart, table["label"].astype(str).tolist(), range(5), settings, 0)
    found = fields.unit_factors(rows, "vec_id", "label", "x", "y", settings).collect()
    assert {r.position: r.factor for r in found} == pytest.approx({i: f for i, f in enumerate(w) if abs(f) > 1e-6}, abs=1e-9)
    assert all((r.split, r.quality) == pytest.approx((cut, quality), abs=1e-9) for r in found)
