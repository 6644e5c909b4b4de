import random

import numpy as np
import pytest

from joingrove.operators import forests as T
from joingrove.operators.models import algorithms


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(float(y), [float(x) for x in v]) for y, v in rows], "label double, v array<double>").repartition(parts)


def crossed(n, seed, dims=4):
    """Label 1 where the first two features lie on the same side: no single feature tells anything."""
    rng = random.Random(seed)
    rows = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(n)]
    return [(int((v[0] > 0) == (v[1] > 0)), v) for v in rows]


def right(model, df):
    rows = model(df).collect()
    return sum(r["prediction"] == r["label"] for r in rows) / len(rows)


@pytest.mark.parametrize("name", ["XT", "XGB"])
def test_a_rule_that_the_majority_and_single_features_fail(spark, name):
    train, test = crossed(1500, 1), crossed(400, 2)
    model = algorithms(name)[0].fit(frame(spark, train))
    assert right(model, frame(spark, test)) > 0.9
    assert max(sum(y for y, _ in test), 400 - sum(y for y, _ in test)) / 400 < 0.6


def test_extra_trees_take_the_best_of_their_random_cuts(spark):
    rows, drawn = crossed(300, 3, 5), []
    trees, dims = T.grow_extra_trees(frame(spark, rows), 6, 4, 7, drawn)
    assert dims == 5
    x, y = np.array([v for _, v in rows]), np.array([float(y) for y, _ in rows])

    def inside(tree, node):
        """Rows of a node, by walking every row."""
        out = []
        for i in range(len(x)):
            at = 0
            while at != node and trees.feature[tree, at] >= 0:
                at = trees.child[tree, at] + (x[i, trees.feature[tree, at]] >= trees.cut[tree, at])
            if at == node:
                out.append(i)
        return out

    nodes = {}
    for tree, node, f, c, left, whole in drawn:
        here = inside(tree, node)
        below = [i for i in here if x[i, f] < c]
        assert whole == (len(here), y[here].sum()) and left == (len(below), y[below].sum())
        above = [i for i in here if x[i, f] >= c]
        gini = lambda s: y[s].sum() * (len(s) - y[s].sum()) / len(s) if s else 0.0
        if below and above and 0 < y[here].sum() < len(here):
            nodes.setdefault((tree, node), []).append((gini(below) + gini(above), f, c))
    assert len(nodes) > 20
    for (tree, node), tried in nodes.items():
        _, f, c = min(tried)
        assert (trees.feature[tree, node], trees.cut[tree, node]) == (f, c)
    roots = {(trees.feature[t, 0], trees.cut[t, 0]) for t in range(6)}
    assert len(roots) == 6  # cuts are drawn, not searched: no two trees begin alike
    for t in range(6):
        for node in range(trees.feature.shape[1]):
            here = inside(t, node) if trees.feature[t, node] < 0 else []
            if here:
                assert trees.value[t, node] == pytest.approx(y[here].mean())


def test_boosting_follows_first_and_second_derivatives(spark):
    rows = crossed(250, 4, 3)
    trees, _ = T.grow_boosted(frame(spark, rows), 3, 2)
    x, y = np.array([v for _, v in rows]), np.array([float(y) for y, _ in rows])
    edges = T._bin_edges(frame(spark, rows), 3)
    score = np.zeros(len(x))
    for t in range(3):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)

        def check(node, here, depth):
            G, H = g[here].sum(), h[here].sum()
            gains = []
            for f in range(3):
                for c in edges[f]:
                    low = here[x[here, f] < c]
                    high = here[x[here, f] >= c]
                    if min(h[low].sum(), h[high].sum()) >= T.LEAST_WEIGHT - 1e-9:
                        parts = [g[s].sum() ** 2 / (h[s].sum() + T.RIDGE) for s in (low, high)]
                        gains.append((sum(parts) - G ** 2 / (H + T.RIDGE), f, c))
            best = max(gains, default=(0.0,))[0]
            if depth == 2 or best <= 1e-9:
                assert trees.feature[t, node] == -1 and trees.value[t, node] == pytest.approx(-T.STEP * G / (H + T.RIDGE))
                score[here] += trees.value[t, node]
                return
            f, c = trees.feature[t, node], trees.cut[t, node]
            mine = next(gain for gain, a, b in gains if a == f and b == c)
            assert mine == pytest.approx(best)
            child = trees.child[t, node]
            check(child, here[x[here, f] < c], depth + 1)
            check(child + 1, here[x[here, f] >= c], depth + 1)

        check(0, np.arange(len(x)), 0)
    assert ((score > 0) == (y > 0)).mean() > 0.6


@pytest.mark.parametrize("name", ["XT", "XGB"])
def test_odd_training_rows(spark, name):
    fit = algorithms(name)[0].fit
    asked = frame(spark, [(1, [0.0, 5.0]), (1, [9.0, 9.0])], 1)
    assert [r["prediction"] for r in fit(frame(spark, [(1, [1.0, 2.0])] * 9, 2))(asked).collect()] == [1.0, 1.0]
    assert [r["prediction"] for r in fit(frame(spark, [(0, [1.0, 2.0])] * 9, 2))(asked).collect()] == [0.0, 0.0]
    assert fit(frame(spark, [(1, []), (1, []), (0, [])], 1))(frame(spark, [(1, [])], 1)).first()["prediction"] == 1.0
    assert fit(frame(spark, [], 1))(asked).count() == 2
    assert fit(frame(spark, [(1, [1.0, 2.0])] * 3, 1))(asked.limit(0)).count() == 0
