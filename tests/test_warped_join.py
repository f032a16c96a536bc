"""The radius join under warping against the matrix of all costs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motionframe.operators import cluster, warped_join
from motionframe.plans import clustering
from tests.conftest import SF


def plain_cost(x, y):
    table = np.full((len(x) + 1, len(y) + 1), np.inf)
    table[0, 0] = 0
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            table[i + 1, j + 1] = abs(a - b) + min(table[i, j], table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


_series = st.integers(1, 20).flatmap(lambda n: st.tuples(*[st.lists(st.floats(-5, 5), min_size=n, max_size=n)] * 2))


@settings(max_examples=200, deadline=None)
@given(_series, st.integers(1, 9))
def test_envelopes_bound_the_cost(pair, segments):
    x, y = pair
    bound = warped_join.envelope_bound(np.array([x, y]), np.array([y, x]), segments)
    assert (bound <= plain_cost(x, y) + 1e-9).all()


def test_single_samples_are_their_own_envelopes():
    x, y = np.random.default_rng(3).normal(size=(2, 5, 8))
    assert warped_join.envelope_bound(x, y, 8) == pytest.approx([max(0, plain) for plain in warped_join.envelope_bound(x, y, 8)])
    one = np.array([[1.0, 4.0]])
    assert warped_join.envelope_bound(one, one + 10, 2)[0] == 17.0 and warped_join.envelope_bound(one, one, 2)[0] == 0.0


@pytest.mark.parametrize("tile", [7, 1000])
def test_same_pairs_as_the_matrix(spark, tile):
    rng = np.random.default_rng(0)
    shapes = np.cumsum(rng.normal(size=(12, 32)), axis=1)
    rows = [(i % 2, i, (shapes[i % 12] + rng.normal(0, 0.05, 32)).tolist()) for i in range(240)]
    rows += [(0, 1000, [float("nan")] * 32), (0, 1001, [0.0] * 32), (0, 1002, None), (1, 1003, rows[1][2])]
    series = spark.createDataFrame(rows, "label int, vec_id long, x array<double>")
    matrix = cluster.dtw_matrix(series.where("x IS NOT NULL"), ["label"], "vec_id", "x").cache()
    for eps in (0.0, 0.08, 1.0, 1e6):
        found = {(r.label, r.a, r.b): r.d for r in warped_join.warped_within(series, ["label"], "vec_id", "x", eps, tile).collect()}
        assert found == pytest.approx({(r.label, r.a, r.b): r.d for r in matrix.where(F.col("d") <= eps).collect()})
        assert eps == 0.0 or len(found) >= 100
    computed = warped_join.cost_share(series, ["label"], warped_join.warped_candidates(series, ["label"], "vec_id", "x", 0.08, tile))
    assert computed < 0.2  # of the pairs that the matrix has


def test_clusters_of_whole_series(spark):
    series = spark.read.parquet(f"{SF}/embeddings.parquet").select("label", "vec_id", "embedding")
    matrix = cluster.dtw_matrix(series, ["label"], "vec_id", "embedding").cache()
    pairs = clustering.warped_radius(spark, SF)
    assert {(r.a, r.b, r.cost) for r in pairs.collect()} == {(r.a, r.b, round(r.d, 6)) for r in matrix.where(F.col("d") <= clustering.WARPED_EPS).collect()} and pairs.count() > 20
    expected = cluster.dbscan(matrix, series.select("label", F.col("vec_id").alias("a")), ["label"], F.lit(clustering.WARPED_EPS), 3)
    assert sorted(clustering.warped_density(spark, SF).collect()) == sorted(expected.collect())


def test_pairs_are_left_early_and_never_rows(spark):
    """Pairs that cost too much are left, the others have the cost of the plain way to the bit, and no pair of series is a row."""
    from motionframe.operators import tiles

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(600, 32)), rng.normal(size=(600, 32))
    y[::3] = x[::3] + rng.normal(size=(200, 32)) * 0.1
    whole = tiles.warp_costs(x, y)
    for most in (0.0, float(np.median(whole)), float(whole.max())):
        early = tiles.warp_costs(x, y, most=most)
        assert (early[whole <= most] == whole[whole <= most]).all() and (early[whole > most] > most).all()
    df = spark.createDataFrame([(k % 2, k, [float(v) for v in s]) for k, s in enumerate(np.r_[x[:60], y[:60]])] + [(0, 999, None)], "label int, vec_id long, x array<double>")
    eps = float(np.quantile(whole, 0.4)) / (32 * 2**0.5)
    pairs = lambda d: {(r.label, r.a, r.b, r.d) for r in d.collect()}
    found = warped_join.tiled_within(df, ["label"], "vec_id", "x", eps)
    assert pairs(found) == pairs(warped_join.warped_within(df, ["label"], "vec_id", "x", eps)) and found.count()



def test_templates_need_no_matrix(spark, monkeypatch):
    """Clustered templates come from tiles, not from a row per pair."""
    from motionframe.operators import templates

    def refuse(*_, **__):
        raise AssertionError("a row per pair")

    monkeypatch.setattr(cluster, "dtw_matrix", refuse)
    waves = [[float(v) for v in np.sin(np.linspace(0, 6, 20)) + k * 0.001] for k in range(5)]
    df = spark.createDataFrame([(1, k, w, [1] * 10 + [2] * 10) for k, w in enumerate(waves)], "channel int, k int, x array<double>, m array<int>")
    found = templates.clustered_templates(df, ["channel"], "k", "x", "m", cluster.label_table(2, 2.0), eps=0.2, rounds=2).collect()
    assert [r.members for r in found] == [5] and found[0].labels == [1] * 10 + [2] * 10
