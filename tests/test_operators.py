import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motionframe import schema
from motionframe.functions import geometry as g
from motionframe.operators import cluster, cycles, pairs, split, templates, trajectory


def test_gap_fill_leaves_ends_open(spark):
    v = [None, 1.0, 2.0, None, None, 5.0, 6.0, 7.0, 8.0, None]
    df = spark.createDataFrame([(1, float(i), x) for i, x in enumerate(v)], "s int, t double, v double")
    filled = [r.filled for r in trajectory.fill_gaps(df, ["s"], "t", "v").orderBy("t").collect()]
    assert filled == [None, 1, 2, 3, 4, 5, 6, 7, 8, None]
    gaps = trajectory.detect_gaps(df, ["s"], "t", "v").orderBy("start_t").collect()
    assert [(r.start_t, r.end_t, r.points) for r in gaps] == [(0, 0, 1), (3, 4, 2), (9, 9, 1)]


def test_resample_is_exact_on_lines(spark):
    df = spark.createDataFrame([(1, i * 4.0, i * 8.0) for i in range(5)], "s int, t double, v double")
    out = trajectory.resample(df, ["s"], "t", "v", 30, 120).orderBy("t").collect()
    assert len(out) == 17 and all(r.v == 2 * r.t for r in out)


def test_cycles_ignore_repeated_starts(spark):
    marks = [2, 1, 1, 2, 3, 1, 2]
    df = spark.createDataFrame([(1, float(i), m) for i, m in enumerate(marks)], "s int, t double, mark int")
    assert [r.cycle for r in cycles.segment_cycles(df, ["s"], "t", "mark").orderBy("t").collect()] == [0, 1, 1, 1, 1, 2, 2]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.booleans()), min_size=1, max_size=14))
def test_asof_is_nearest(spark, points):
    left = [(1, float(t), i) for i, (t, side) in enumerate(points) if side]
    right = [(1, float(t), i) for i, (t, side) in enumerate(points) if not side]
    a = spark.createDataFrame(left, "s int, t double, l long")
    b = spark.createDataFrame(right, "s int, t double, r long")
    found = {r.l: (r.r, r.gap) for r in cycles.asof_nearest(a, b, ["s"], "t", "l", "r").collect()}
    for _, t, i in left:
        best = min(((abs(t - u), u, j) for _, u, j in right), default=None)
        assert found[i] == ((best[2], best[0]) if best else (None, None))


def test_rotations_round_trip(spark):
    rows = [(1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (1.0, 2.0, 3.0, -1.0, 0.5, 2.0), (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "ax double, ay double, az double, bx double, by double, bz double")
    a, b = (F.col("ax"), F.col("ay"), F.col("az")), (F.col("bx"), F.col("by"), F.col("bz"))
    df = df.withColumn("r", F.array(*g.log_map(a, b)))
    m = g.exp_map(tuple(F.get("r", F.lit(i)) for i in range(3)))
    turned = [g.dot(m[3 * i : 3 * i + 3], a) for i in range(3)]
    for r, source in zip(df.select(F.array(*turned).alias("t")).collect(), rows):
        u, v = np.array(source[:3]), np.array(source[3:])
        assert np.allclose(np.array(r.t) / np.linalg.norm(u), v / np.linalg.norm(v))


def test_dtw_against_all_paths():
    rng = np.random.default_rng(0)

    def brute(a, b, i=0, j=0):
        here = abs(a[i] - b[j])
        if i == len(a) - 1 and j == len(b) - 1:
            return here
        return here + min(brute(a, b, i + x, j + y) for x, y in ((1, 1), (1, 0), (0, 1)) if i + x < len(a) and j + y < len(b))

    for _ in range(10):
        a, b = rng.normal(size=(2, 5))
        cost, _ = cluster.dtw_batch(a[None], b[None])
        assert np.isclose(cost[-1, -1, 0], brute(a, b))
        assert cluster.dtw_batch(a[None], a[None])[0][-1, -1, 0] == 0
        x, y = rng.normal(size=(2, 7, 6))
        factor = cluster.label_factors(rng.integers(1, 4, (7, 6)), rng.integers(1, 4, (7, 6)), cluster.label_table(3, 2.0))
        for kind in ({}, {"factor": factor}, {"lam": 0.5}):
            assert np.allclose(cluster.dtw_batch(x, y, **kind)[0][-1, -1], cluster.dtw_total(cluster.cell_costs(x, y, **kind)))


def test_spline_is_exact_on_lines_and_smooth():
    y = np.array([0, 1, np.nan, 3, np.nan, np.nan, 6, np.nan])
    assert np.allclose(cluster.natural_spline(y), np.arange(8))
    x = np.linspace(0, 3, 31)
    y = np.sin(x)
    y[5:25:3] = np.nan
    assert np.allclose(cluster.natural_spline(y), np.sin(x), atol=1e-3)
    many = np.stack([y, np.cos(x), np.full(31, np.nan)])
    many[1, ::4] = np.nan
    together = cluster.natural_spline(many)
    assert np.array_equal(together[0], cluster.natural_spline(y)) and np.array_equal(together[1], cluster.natural_spline(many[1])) and np.isnan(together[2]).all()
    assert np.allclose(cluster.natural_spline(np.array([np.nan, 1, np.nan, 4, 5, np.nan]), linear=True), [-0.5, 1, 2.5, 4, 5, 6])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=25))
def test_persistence_pairs_distinct_extrema(values):
    y = np.array(values)
    found = cluster.persistence(y)
    assert len({p[0] for p in found}) == len(found) and all(p[2] >= 0 for p in found)
    lowest = min(range(len(y)), key=lambda i: (y[i], i))
    assert lowest not in {p[0] for p in found}


def test_split_beats_parent_and_handles_missing(spark):
    rows = [(1.0, 0), (1.0, 0), (2.0, 1), (3.0, 1), (None, 1), (float("nan"), 0)]
    df = spark.createDataFrame(rows, "x double, y int").withColumn("f", F.lit(0))
    r = split.best_split(df, ["f"], "x", "y", [0, 1]).first()
    assert (r.threshold, r.quality) == (1.5, 4.0)


def test_tree_learns_and_forest_votes(spark, tmp_path):
    rows = [(i, [float(i % 10), float(i % 7), 0.0], int(i % 10 > 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, x array<double>, y int")
    tree = split.grow_trees(df, "k", "x", "y", 3, [0, 1], [0], 3, look=3, bootstrap=False)
    assert tree.predict(df, ["k", "y"], "x").where("predicted <> y").count() == 0
    forest = split.grow_forest(df, "k", "x", "y", 3, [0, 1], 3, 2)
    voted = split.predict_forest(df, ["k", "y"], "x", forest)
    assert split.evaluate(voted, "y", "predicted").first().accuracy > 0.5
    forest.save(str(tmp_path / "forest"))
    again = split.Forest.load(spark, str(tmp_path / "forest"))
    assert sorted(again.predict(df, ["k", "y"], "x").collect()) == sorted(voted.collect())
    assert again.trees() == [0, 1, 2] and again.keep([1]).trees() == [1]
    shares = again.probabilities(df, ["k"], "x", [0, 1]).collect()
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in shares) and {len(r.given) for r in again.component(df, ["k"], "x").collect()} == {3}


def test_missing_values_go_to_the_larger_side(spark):
    rows = [(i, [float(i)], int(i > 11)) for i in range(16)] + [(20, [None], 1)]
    df = spark.createDataFrame(rows, "k int, x array<double>, y int")
    tree = split.grow_trees(df, "k", "x", "y", 1, [0, 1], [0], 1, bootstrap=False)
    root = tree.nodes.where("node = 1").first()
    assert (root.feature, root.threshold, root.default_left) == (0, 11.5, True)
    assert {r.k: r.predicted for r in tree.predict(df, ["k"], "x").collect()}[20] == 0
    assert split.least_samples(50) == 1 and split.least_samples(10**6) == 100 and split.mtry(64) == 8


def test_forest_stops_when_it_no_longer_improves(spark):
    df = spark.createDataFrame([(i, [float(i)], int(i > 9)) for i in range(20)], "k int, x array<double>, y int")
    assert len(split.grow_forest(df, "k", "x", "y", 1, [0, 1], 12, 1, chunk=1).trees()) < 12


def test_allocation_sums_to_about_the_budget(spark):
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate([1, 2, 3, 5, 8])], "k int, w double")
    shares = [r.share for r in pairs.allocate(df, "w", 100).collect()]
    assert abs(sum(shares) - 100) <= 3


def test_dbscan_finds_two_shapes(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, (np.array([0.0, 1, 0, -1]) * (1 if i < 10 else -3) + rng.normal(0, 0.01, 4)).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    d = cluster.distance_matrix(df, ["label"], "vec_id", "embedding")
    found = cluster.dbscan(d, df.select("label", F.col("vec_id").alias("a")), ["label"], F.lit(0.5), 3).toPandas()
    assert found.groupby("cluster").a.apply(sorted).tolist() == [list(range(10)), list(range(10, 20))]


def test_dbscan_keeps_classes_with_the_same_ids_apart(spark):
    rows = [(i, label, [float(10 * label + i % 2 * 5), 0.01 * i]) for label in (0, 1) for i in range(3, 13)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    d = cluster.distance_matrix(df, ["label"], "vec_id", "embedding")
    found = cluster.dbscan(d, df.select("label", F.col("vec_id").alias("a")), ["label"], F.lit(0.5), 3).toPandas()
    assert len(found) == 20 and {(r.label, r.a): r.cluster for r in found.itertuples()} == {(label, i): 3 + (i + 1) % 2 for label in (0, 1) for i in range(3, 13)}


def test_eps_falls_back(spark):
    d = spark.createDataFrame([(0, 1, 2, 1.0)], "label int, a long, b long, d double")
    classes = spark.createDataFrame([(0,), (7,)], "label int")
    assert {(r.label, r.eps, r.min_pts) for r in cluster.estimate_eps(d, ["label"], classes=classes).collect()} == {(0, 1.0, 3), (7, 0.1, 3)}


def test_templates_of_two_shapes(spark):
    rng = np.random.default_rng(1)
    wave = np.sin(np.linspace(0, 6, 12))
    rows = [(i, 0, ((wave if i < 12 else -3 * wave) + rng.normal(0, 0.3, 12)).tolist(), [1] * 12) for i in range(24)]
    rows.append((99, 0, [float("nan")] * 12, [1] * 12))
    df = spark.createDataFrame(rows, "vec_id long, label int, x array<double>, m array<int>")
    found = templates.clustered_templates(df, ["label"], "vec_id", "x", "m", cluster.label_table(1, 2.0), lam=None).collect()
    assert found and all(len(r["values"]) == 12 and not np.isnan(r["values"]).any() and r.labels == [1] * 12 for r in found) and sum(r.members for r in found) <= 24
    for r in found:
        if r.members == 12 and r.cluster in (0, 12):
            assert np.abs(np.array(r["values"]) - (wave if r.cluster == 0 else -3 * wave)).max() < 1.0


def test_persistent_events_drop_faint_and_border_extrema(spark):
    y = [0.0, 5.0, 1.0, 1.2, 1.1, 6.0, 0.5, 4.0, 3.9, 8.0, 2.0]
    df = spark.createDataFrame([(1, y), (2, [0.0] * 11)], "k long, x array<double>")
    assert {(r.k, r.pos) for r in cluster.persistent_events(df, ["k"], "x").collect()} == {(1, 5), (1, 6)}


def test_barycentre_of_copies_is_the_copy_with_its_labels(spark):
    x, marks = [0.0, 1.0, 4.0, 2.0], [1, 1, 2, 3]
    df = spark.createDataFrame([(i, 0, x, marks) for i in range(5)], "k long, c int, x array<double>, m array<int>")
    assert [r.value for r in cluster.barycentres(df, "c", "k", "x").orderBy("frame").collect()] == x
    found = templates.labelled_barycentres(df, "c", "k", "x", "m", cluster.label_table(3, 2.0), None).orderBy("frame").collect()
    assert [(r.value, r.label) for r in found] == list(zip(x, marks))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "s int, t double, v double")
    assert trajectory.fill_gaps(empty, ["s"], "t", "v").count() == 0
    assert trajectory.time_normalise(empty, ["s"], "t", "v", 5).count() == 0
    assert split.best_split(empty.withColumn("y", F.lit(0)), ["s"], "v", "y", [0, 1]).count() == 0
    with pytest.raises(ValueError):
        schema.require(empty, "nothing")
