"""Queries that have no SQL against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionframe import schema
from motionframe.operators import cluster, split, tiles, trajectory
from motionframe.plans import clustering, samples
from motionframe.plans import mining as plans
from tests.conftest import SF


def test_splines(spark):
    found = {r.vec_id: r.filled for r in clustering.spline_fill(spark, SF).collect()}
    series = {r.vec_id: np.array(r.embedding, float) for r in clustering._series(spark, SF).collect()}
    knots = np.array([i for i in range(64) if i % 5])
    h = np.diff(knots).astype(float)
    system = np.eye(len(knots))
    for k in range(1, len(knots) - 1):
        system[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
    for name, y in series.items():
        v = y[knots]
        right = np.zeros(len(knots))
        right[1:-1] = 6 * np.diff(np.diff(v) / h)
        bend = np.linalg.solve(system, right)
        expected = y.copy()
        for i in range(5, 64, 5):
            k = np.searchsorted(knots, i) - 1
            a, b = (knots[k + 1] - i) / h[k], (i - knots[k]) / h[k]
            expected[i] = a * v[k] + b * v[k + 1] + ((a**3 - a) * bend[k] + (b**3 - b) * bend[k + 1]) * h[k] ** 2 / 6
        expected[0] = v[0] - ((v[1] - v[0]) / h[0] - h[0] * bend[1] / 6)
        assert found[name] == pytest.approx(expected.tolist(), abs=2e-6)


def test_balanced_draws(spark):
    found = {(r.pos, r.l1): r.quality for r in samples.balanced_quality(spark, SF).collect()}
    points = schema.components(clustering._series(spark, SF))
    rows = points.where("pos IN (0, 7, 63)").select("pos", "label", "x", *[F.xxhash64("x", F.lit(d), F.lit(1)).alias(f"h{d}") for d in range(4)]).toPandas()
    assert {k[0] for k in found} == set(range(64))
    for pos in (0, 7, 63):
        for low in (0, 4, 8):
            here, draws = rows[rows.pos == pos], []
            size = min((here.label == low).sum(), (here.label == low + 1).sum())
            for d in range(4):
                taken = sorted((float(x), c) for c in (low, low + 1) for x in here[here.label == c].sort_values([f"h{d}", "x"]).x.to_numpy()[:size])
                best = 0.0
                for i in range(len(taken) - 1):
                    if taken[i + 1][0] > taken[i][0] + 2 * 1.1920929e-07:
                        sides = [[c for _, c in taken[: i + 1]], [c for _, c in taken[i + 1 :]]]
                        best = max(best, sum(sum(s.count(c) ** 2 for c in (low, low + 1)) / len(s) for s in sides))
                draws.append(best)
            assert found[pos, low] == pytest.approx(np.mean(draws), abs=1e-6)


def test_votes_of_a_forest(spark):
    found = {r.vec_id: (r.votes, r.predicted) for r in plans.forest_predict(spark, SF).collect()}
    rows = clustering._series(spark, SF)
    nodes = {(r.tree, r.node): r for r in split.grow_forest(rows, "vec_id", "embedding", "label", 64, list(range(10)), trees=3, depth=3).nodes.collect()}
    for r in rows.collect():
        given = []
        for tree in range(3):
            at = nodes[tree, 1]
            while at.feature is not None:
                at = nodes[tree, at.left if r.embedding[at.feature] <= at.threshold else at.right]
            given.append(at.label)
        best = min(set(given), key=lambda c: (-given.count(c), c))
        assert found[r.vec_id] == (given.count(best), best)


def plain_barycentre(xs, rounds=100):
    n = len(xs[0])
    flat = [[v - (x[-1] - x[0]) / n * i for i, v in enumerate(x)] for x in xs]
    last = lambda f, pick: max(i for i, v in enumerate(f) if v == pick(f))
    ends = [(last(f, min), last(f, max)) for f in flat]
    low, high = (float(np.median([e[i] for e in ends])) for i in (0, 1))
    shape, seen = list(xs[min(range(len(xs)), key=lambda k: (abs(ends[k][0] - low) + abs(ends[k][1] - high), k))]), set()
    for _ in range(rounds):
        state = tuple(round(v, 9) for v in shape)
        if state in seen:
            break
        seen.add(state)
        held = [[] for _ in range(n)]
        for x in xs:
            cost = np.full((n + 1, n + 1), np.inf)
            cost[0, 0] = 0
            for i in range(n):
                for j in range(n):
                    cost[i + 1, j + 1] = abs(shape[i] - x[j]) + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
            i = j = n
            while i and j:
                held[i - 1].append(x[j - 1])
                d, up, back = cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1]
                i, j = (i - 1, j - 1) if d <= up and d <= back else (i - 1, j) if up <= back else (i, j - 1)
        shape = [sum(h) / len(h) for h in held]
    return shape


def test_barycentres(spark):
    rng = np.random.default_rng(6)
    rows = [(c, k, (np.roll(np.cumsum(np.random.default_rng(c).normal(size=9)), k % 3) + rng.normal(0, 0.1, 9)).tolist()) for c in range(3) for k in range(6)]
    found = cluster.barycentres(spark.createDataFrame(rows, "c int, k int, x array<double>"), "c", "k", "x").toPandas()
    for c in range(3):
        assert found[found.c == c].sort_values("frame").value.tolist() == pytest.approx(plain_barycentre([r[2] for r in rows if r[0] == c]), abs=1e-7)
    assert clustering.dba_templates(spark, SF).where("value IS NULL").count() == 0


def test_lowest_bins_only(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(0, i, [float(v) for v in rng.normal(size=4)]) for i in range(700)], "c int, k long, x array<double>")
    assert tiles.meet(rows, ["c"], "k", "x", [], lambda u: iter([{"a": u.left.keys[:1], "n": np.ones(1, np.int64)}]), "n long").count() > 1  # several tiles
    whole = tiles.bin_means(rows, ["c"], "k", "x", tiles.by_l1(6), 20).toPandas()
    some = tiles.bin_means(rows, ["c"], "k", "x", tiles.by_l1(6), 20, few=5).toPandas()
    assert len(some) < len(whole)  # the others never leave a task
    lowest = lambda t: t.sort_values(["a", "bin"]).groupby("a").head(5).reset_index(drop=True)
    a, b = lowest(whole), lowest(some)
    assert (a[["a", "bin"]] == b[["a", "bin"]]).all().all()
    assert np.allclose(a.m, b.m, rtol=1e-12)


def test_tiles_of_a_class_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(tiles, "SPREAD", 1)
    rows = spark.createDataFrame([(0, i, [float(i)]) for i in range(900)], "c int, k long, x array<double>")
    units = tiles.meet(rows, ["c"], "k", "x", [], lambda u: iter([{"a": u.left.keys[:1], "n": np.ones(1, np.int64)}]), "n long").count()
    assert units == 16 * 17 // 2
    assert tiles.counts(rows, ["c"], "k", "x", tiles.by_l1(), 1.5).agg(F.sum("n")).first()[0] == 2 * 899


def test_shapes_are_sent_to_the_series(spark, capsys):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i % 3, i, [float(v) for v in rng.normal(size=6)]) for i in range(30)], "c int, k long, x array<double>")
    seen, few = [], cluster.SHAPES
    spark_map = type(rows).mapInPandas

    def spy(self, *args, **kw):
        self.explain()
        seen.append(capsys.readouterr().out)
        return spark_map(self, *args, **kw)

    type(rows).mapInPandas = spy
    try:
        found = {(r.c, r.frame): r.value for r in cluster.barycentres(rows, "c", "k", "x", 3).collect()}
        cluster.SHAPES = 2  # fewer than the classes: both sides are shuffled
        moved = {(r.c, r.frame): r.value for r in cluster.barycentres(rows, "c", "k", "x", 3).collect()}
    finally:
        type(rows).mapInPandas, cluster.SHAPES = spark_map, few
    assert "BroadcastHashJoin" in seen[0]
    assert set(found) == set(moved) and all(abs(found[k] - moved[k]) < 1e-9 for k in found)


def test_regression_streams_through_small_batches(spark, capsys):
    rng = np.random.default_rng(5)
    rows = [(c, float(x), float(rng.normal())) for c, n in enumerate((1, 2, 3, 40, 61)) for x in np.sort(rng.choice(200, n, replace=False))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        frame = trajectory.lowess(spark.createDataFrame(rows, "c int, t double, v double"), ["c"], "t", "v", 0.2)
        found = {(r.c, r.t): r.smooth for r in frame.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    frame.explain()
    assert "Join" not in capsys.readouterr().out  # neighbours are no rows
    assert len(found) == len(rows)
    for c, t, _ in rows:
        own = [(abs(x - t), x, v) for d, x, v in rows if d == c]
        near = sorted(own)[: min(len(own), max(2, int(len(own) * 0.2 + 1e-10)))]
        h = near[-1][0]
        w = np.array([1.0 if h == 0 or d / h <= 0.001 else 0.0 if d / h >= 0.999 else (1 - (d / h) ** 3) ** 3 for d, *_ in near])
        x, y = np.array([x - t for _, x, _ in near]), np.array([v for *_, v in near])
        spread = w.sum() * (w * x * x).sum() - (w * x).sum() ** 2
        expected = ((w * x * x).sum() * (w * y).sum() - (w * x).sum() * (w * x * y).sum()) / spread if spread > 1e-9 * w.sum() * (w * x * x).sum() else (w * y).sum() / w.sum()
        assert found[c, t] == pytest.approx(expected, abs=1e-9)
