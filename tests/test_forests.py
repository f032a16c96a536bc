"""Bootstrap draws, accepted trees and large forests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionframe.operators import split


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    rows = [(i, [None if j == 3 and i % 50 == 0 else float(v) for j, v in enumerate(r)], int(r[0] + 0.3 * r[1] > 0) + int(r[2] > 1)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "k long, x array<double>, y int").cache()


@pytest.mark.parametrize("block", [10_000, 40])
def test_draws_sum_to_the_rows(noisy, monkeypatch, block):
    monkeypatch.setattr(split, "BLOCK", block)
    found = {r.k: r.weights for r in split.bootstrap_weights(noisy, "k", list(range(30)), 5).collect()}
    assert len(found) == 600
    weights = np.array(list(found.values()))
    assert (weights.sum(axis=0) == 600).all() and weights.max() >= 5  # beyond four, too
    shares = [(weights == c).mean() for c in range(4)]
    assert shares == pytest.approx([np.exp(-1) / f for f in (1, 1, 2, 6)], abs=0.02)
    assert abs(np.corrcoef(weights.T)[np.triu_indices(30, 1)]).max() < 0.2 and weights.mean(axis=1).std() < 0.25
    again = {r.k: r.weights for r in split.bootstrap_weights(noisy.repartition(7), "k", list(range(30)), 5).collect()}
    assert again == found
    assert {r.k: r.weights[0] for r in split.bootstrap_weights(noisy, "k", [7], 5).collect()} == {k: w[7] for k, w in found.items()}  # trees do not touch each other


def test_roots_weigh_all_draws(noisy):
    forest = split.grow_trees(noisy, "k", "x", "y", 4, [0, 1, 2], [0, 1, 2], 2)
    assert {r.n for r in forest.nodes.where("node = 1").collect()} == {600.0}
    inner = forest.nodes.where("feature IS NOT NULL").count()
    assert forest.nodes.count() == 2 * inner + 3 and set(forest.depths().values()) == {2}


def test_shallow_trees_are_replaced(noisy, spark):
    forest = split.grow_forest(noisy, "k", "x", "y", 4, [0, 1, 2], 3, 4)
    assert len(forest.trees()) == 3 and min(forest.depths().values()) >= 2
    flat = spark.createDataFrame([(i, [float(i % 2)], i % 2) for i in range(40)], "k long, x array<double>, y int")
    with pytest.raises(ValueError, match="none of 6 trees"):
        split.grow_forest(flat, "k", "x", "y", 1, [0, 1], 2, 6)  # one split tells all, so no path is three splits long
    assert split.grow_forest(flat, "k", "x", "y", 1, [0, 1], 2, 3).predict(flat, ["k", "y"], "x").where("predicted <> y").count() == 0


def test_large_forests_are_walked(noisy, monkeypatch):
    forest = split.grow_trees(noisy, "k", "x", "y", 4, [0, 1, 2], [3, 5, 6], 4)
    sent = sorted((r.k, list(r.given)) for r in forest.component(noisy, ["k"], "x").collect())
    monkeypatch.setattr(split.Forest, "MOST", 1)
    monkeypatch.setattr(split, "FEW", 4)  # joins instead of broadcasts from the third level on
    assert sorted((r.k, list(r.given)) for r in forest.component(noisy, ["k"], "x").collect()) == sent and len(sent) == 600
    plain = {(r.tree, r.node): r for r in forest.nodes.collect()}
    for row in noisy.where("k % 97 = 0 OR k % 50 = 0").collect():
        for t, label in zip((3, 5, 6), dict(sent)[row.k]):
            node = 1
            while plain[t, node].feature is not None:
                n = plain[t, node]
                v = row.x[n.feature]
                node = 2 * node + (0 if (n.default_left if v is None else v <= n.threshold) else 1)
            assert plain[t, node].label == label


def test_splits_are_the_best_of_their_node(noisy):
    tree = split.grow_trees(noisy, "k", "x", "y", 4, [0, 1, 2], [0], 3, look=4, bootstrap=False).nodes.collect()
    rows = noisy.collect()
    at = {1: rows}
    for node in sorted(tree, key=lambda r: r.node):
        mine = at[node.node]
        assert node.n == len(mine) and node.risk == len(mine) - max(sum(r.y == c for r in mine) for c in range(3))
        if node.feature is None:
            continue
        best = (0.0, None)
        for f in range(4):
            values = sorted((r.x[f], r.y) for r in mine if r.x[f] is not None)
            left, right = [0] * 3, [sum(c == k for _, c in values) for k in range(3)]
            for i in range(len(values) - 1):
                left[values[i][1]] += 1
                right[values[i][1]] -= 1
                if values[i + 1][0] > values[i][0] + 2 * 1.1920929e-07:
                    quality = sum(c * c for c in left) / sum(left) + sum(c * c for c in right) / sum(right)
                    if quality > best[0] + 1e-9:
                        best = (quality, (f, (values[i][0] + values[i + 1][0]) / 2))
        assert (node.feature, node.threshold) == best[1]
        for r in mine:
            v = r.x[node.feature]
            at.setdefault(2 * node.node + (0 if (node.default_left if v is None else v <= node.threshold) else 1), []).append(r)
    assert noisy.where(F.size("x") != 4).count() == 0


def test_links_off_are_plain_trees(noisy):
    forest = split.grow_trees(noisy, "k", "x", "y", 4, [0, 1, 2], [0], 3)
    assert all((r.left, r.right) == (2 * r.node, 2 * r.node + 1) for r in forest.nodes.where("feature IS NOT NULL").collect())


def best_of(rows, features=range(4)):
    best = (0.0, None, None)
    for f in features:
        values = sorted((r.x[f], r.y) for r in rows if r.x[f] is not None)
        left, right = [0] * 3, [sum(c == k for _, c in values) for k in range(3)]
        for i in range(len(values) - 1):
            left[values[i][1]] += 1
            right[values[i][1]] -= 1
            if values[i + 1][0] > values[i][0] + 2 * 1.1920929e-07:
                quality = sum(c * c for c in left) / sum(left) + sum(c * c for c in right) / sum(right)
                if quality > best[0] + 1e-9:
                    best = (quality, f, (values[i][0] + values[i + 1][0]) / 2)
    return best


def test_linked_branches_against_plain_loops(noisy):
    forest = split.grow_trees(noisy, "k", "x", "y", 4, [0, 1, 2], [0], 3, look=4, bootstrap=False, linked=True)
    nodes = {r.node: r for r in forest.nodes.collect()}
    at, joined = {1: noisy.collect()}, 0
    for level in range(3):
        children = {}
        for node in [n for n in sorted(at) if n.bit_length() == level + 1 and nodes[n].feature is not None]:
            n = nodes[node]
            quality, feature, threshold = best_of(at[node])
            assert (n.feature, n.threshold) == (feature, threshold)
            for r in at[node]:
                v = r.x[feature]
                children.setdefault(2 * node + (0 if (n.default_left if v is None else v <= threshold) else 1), (quality, []))[1].append(r)
        goes = {c: c for c in children}
        if level < 2:
            facts = {}
            for c, (quality, rows) in children.items():
                counts = [sum(r.y == k for r in rows) for k in range(3)]
                facts[c] = (counts.index(max(counts)), 1 - max(counts) / len(rows), quality)
            offered = [min((c for c in (2 * p, 2 * p + 1) if c in facts), key=lambda c: (facts[c][1], -c)) for p in sorted({c // 2 for c in facts})]
            pairs = []
            for i, a in enumerate(offered):
                for b in offered[i + 1 :]:
                    if facts[a][0] == facts[b][0]:
                        quality = best_of(children[a][1] + children[b][1])[0]
                        if round(quality, 9) > round(min(facts[a][2], facts[b][2]), 9):
                            pairs.append((-round(quality, 9), a, b))
            taken = set()
            for _, a, b in sorted(pairs):
                if not {a, b} & taken:
                    taken |= {a, b}
                    goes[b] = a
                    joined += 1
        for c, (_, rows) in children.items():
            at.setdefault(goes[c], []).extend(rows)
            assert (nodes[c // 2].left if c % 2 == 0 else nodes[c // 2].right) == goes[c]
    assert set(nodes) == set(at) and all(nodes[n].n == len(rows) for n, rows in at.items()) and joined
    leaf = {r.k: nodes[n].label for n, rows in at.items() if nodes[n].feature is None for r in rows}
    assert {r.k: r.predicted for r in forest.predict(noisy, ["k"], "x").collect()} == leaf
