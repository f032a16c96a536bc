"""The best cut by bins against a plain scan of the sorted values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionframe.operators import cuts, mining, split


def plain(x, c, classes, weight=None):
    """Threshold and quality of the best cut, by every cut there is."""
    keep = np.isin(c, classes) & ~np.isnan(x) & (np.ones(len(x), bool) if weight is None else weight > 0)
    x, c, w = x[keep], c[keep], (np.ones(keep.sum()) if weight is None else weight[keep])
    values = np.unique(x)
    n = np.array([[w[(x == v) & (c == k)].sum() for k in classes] for v in values])
    left, best = np.cumsum(n, axis=0), None
    for i in range(len(values) - 1):
        if values[i + 1] > values[i] + cuts.GAP:
            a, b = left[i], left[-1] - left[i]
            q = (a * a).sum() / a.sum() + (b * b).sum() / b.sum()
            key = (-round(q, 9), (values[i] + values[i + 1]) / 2)
            best = min(best, (key, q)) if best else (key, q)
    return best and (best[0][1], -best[0][0])


@pytest.mark.parametrize("few", [10, 100_000])
def test_cuts_equal_a_plain_scan(spark, few):
    rng = np.random.default_rng(5)
    groups = {
        0: (rng.normal(size=300), rng.integers(0, 3, 300)),  # classes that nothing tells apart
        1: (np.round(rng.normal(size=300), 1), rng.integers(0, 3, 300)),  # ties
        2: (np.r_[rng.normal(size=100), 5 + rng.normal(size=100)], np.repeat([0, 2], 100)),  # parted, one class missing
        3: (rng.normal(size=50), np.ones(50, int)),  # one class
        4: (np.exp(rng.normal(size=200) * 4), rng.integers(0, 3, 200)),  # nearly all in one bin
        5: (np.full(20, 2.5), rng.integers(0, 3, 20)),  # no cut
        6: (np.r_[rng.normal(size=30), np.nan, np.inf, -np.inf], rng.integers(0, 3, 33)),
        7: (1 + np.arange(60) * 1e-7, rng.integers(0, 3, 60)),  # neighbours too near to be cut between
    }
    rows = [(g, float(x), int(c)) for g, (xs, cs) in groups.items() for x, c in zip(xs, cs)]
    df = spark.createDataFrame(rows, "g int, x double, y int").repartition(5)
    questions = [(0, [0, 1, 2]), (0, [0, 1]), (0, [0, 2]), (0, [1, 2])]
    found = {(r.g, r.question): (r.threshold, r.quality) for r in cuts.best_cuts(df, ["g"], "x", "y", [0, 1, 2], questions, bins=16, few=few).collect()}
    expected = {(g, m): p for g, (x, c) in groups.items() for m, (_, k) in enumerate(questions) if (p := plain(x, c, k))}
    assert found.keys() == expected.keys()
    for k, (t, q) in expected.items():
        assert found[k][0] == t and found[k][1] == pytest.approx(q, abs=1e-8), k


def test_cuts_by_weights_and_few_rows_sorted(spark):
    rng = np.random.default_rng(6)
    x, c, v = rng.normal(size=4000), rng.integers(0, 2, 4000), rng.integers(0, 3, 4000)
    x = x + (c == 1) * 1.0
    df = spark.createDataFrame([(0, float(a), int(b), int(k), int(k > 0)) for a, b, k in zip(x, c, v)], "g int, x double, y int, u int, v int")
    for few in (20, 10_000):
        found = {r.question: (r.threshold, r.quality) for r in cuts.best_cuts(df, ["g"], "x", "y", [0, 1], [(0, [0, 1]), (1, [0, 1])], ["u", "v"], bins=64, few=few).collect()}
        for m, w in ((0, v), (1, (v > 0).astype(int))):
            t, q = plain(x, c, [0, 1], w)
            assert found[m][0] == t and found[m][1] == pytest.approx(q, abs=1e-8)
    a, b, total = np.array([[3.0, 9.0]]), np.array([[5.0, 9.0]]), np.array([40.0, 30.0])
    assert cuts.reach(a, b, total)[0] >= max(sum((s * s).sum() / s.sum() for s in (np.array([k, 9.0]), total - [k, 9.0])) for k in (3, 4, 5))


def test_a_task_judges_part_of_a_group(spark, monkeypatch, tmp_path):
    """A group's bins are judged some intervals at a time: what a task holds does not grow with the group."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    log, apply = str(tmp_path / "rows"), PandasCogroupedOps.applyInPandas

    def noted(self, run, schema):
        def counted(left, right):
            with open(log, "a") as out:
                out.write(f"{len(left)}\n")
            return run(left, right)

        return apply(self, counted, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", noted)
    monkeypatch.setattr(cuts, "PART", 3)
    rng = np.random.default_rng(8)
    x, c = rng.normal(size=3000), rng.integers(0, 2, 3000)
    df = spark.createDataFrame([(0, float(a), int(b)) for a, b in zip(x, c)] + [(None, 1.0, 0), (None, 2.0, 1)], "g int, x double, y int")
    found = {r.g: (r.threshold, r.quality) for r in cuts.best_cuts(df, ["g"], "x", "y", [0, 1], [(0, [0, 1])], bins=32, few=20).collect()}
    t, q = plain(x, c, [0, 1])
    assert found.keys() == {0} and found[0][0] == t and found[0][1] == pytest.approx(q, abs=1e-8)
    rows = [int(v) for v in open(log)]
    assert max(rows) <= 3 * 32 * 2 < sum(rows)


def test_split_does_not_hang_on_where_rows_lie(spark):
    """The same rows give the same cut however they are dealt; values are not sketched by tasks."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(0, float(a), int(b)) for a, b in zip(rng.normal(size=30_000), rng.integers(0, 2, 30_000))], "f int, x double, y int")
    found = {tuple(split.best_split(df.repartition(p, F.xxhash64("x", F.lit(p))), ["f"], "x", "y", [0, 1]).first()) for p in (1, 7)}
    assert len(found) == 1
    plan = split.best_split(df, ["f"], "x", "y", [0, 1])._jdf.queryExecution().toString()
    assert "percentile_approx" not in plan


def test_draws_take_rows_of_least_hash(spark):
    rows = [(g, i, 1 + (i % 7 > 0) + (i % 7 > 2)) for g in (1, 2) for i in range(700 + g)] + [(3, 1, 1), (3, 2, 2)]
    df = spark.createDataFrame(rows, "g int, k int, label int")
    found = mining.drawn(df, ["g"], ["k"], "label", 3, 2, 9).toPandas()
    assert set(found.g) == {1, 2}
    hashed = df.select("*", *[F.xxhash64(F.lit(d), F.lit(9), "k").alias(f"h{d}") for d in (0, 1)]).where("g < 3").toPandas()
    for d in (0, 1):
        for (g, label), part in hashed.groupby(["g", "label"]):
            least = hashed[hashed.g == g].groupby("label").size().min()
            expected = set(part.sort_values([f"h{d}", "k"]).k[:least])
            assert set(found[(found.g == g) & (found.label == label) & (found[f"_draw{d}"] == 1)].k) == expected
