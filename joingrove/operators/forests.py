"""Extra trees and second-order boosting (F3): trees grown a level at a time from sums over all rows.

The driver holds the trees, which are small, and decides on splits; rows are only read. For a level each task sends its
rows down the trees and adds up what their open nodes need in numpy; sums of equal places meet in one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from joingrove.sources.shipping import ship

SEED = 10
# Extra trees: number, depth; cuts drawn per node are the square root of the number of features.
TREES, DEPTH = 50, 8
# Boosting: rounds, depth, step, bins of a feature, ridge on the leaves, least sum of second derivatives in a leaf.
ROUNDS, BOOST_DEPTH, STEP, BINS, RIDGE, LEAST_WEIGHT = 20, 4, 0.3, 64, 1.0, 1.0


@dataclass
class Trees:
    """Trees side by side, an array row each. Node 0 is a root; `feature` is -1 at leaves, `child` the left child, with
    the right one next to it. Rows below `cut` go left."""
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray

    @staticmethod
    def roots(n: int, depth: int) -> "Trees":
        size = (n, (2 << depth) - 1)
        return Trees(np.full(size, -1), np.zeros(size), np.zeros(size, int), np.zeros(size))

    def leaves(self, x: np.ndarray, depth: int) -> np.ndarray:
        """For each row and tree the node that the row ends in."""
        at = np.zeros((len(x), len(self.feature)), int)
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        for _ in range(depth):
            feature = self.feature[tree, at]
            right = x[row, np.maximum(feature, 0)] >= self.cut[tree, at] if x.shape[1] else np.zeros(at.shape, bool)
            at = np.where(feature >= 0, self.child[tree, at] + right, at)
        return at

    def split(self, tree: int, node: int, feature: int, cut: float, free: list[int]) -> int:
        left = free[tree]
        self.feature[tree, node], self.cut[tree, node], self.child[tree, node] = feature, cut, left
        free[tree] += 2
        return left


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=float).reshape(len(vectors), dims)


def _sums(rows: DataFrame, add: Callable[[np.ndarray, np.ndarray], np.ndarray], dims: int, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of what `add` makes of a batch: an array of `shape`, whose last axis is a pair."""
    places = int(np.prod(shape[:-1]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((places, 2))
        for f in frames:
            total += add(_matrix(f["v"], dims), f["label"].to_numpy(float)).reshape(places, 2)
        some = np.flatnonzero(total.any(1))
        yield pd.DataFrame({"place": some, "a": total[some, 0], "b": total[some, 1]})

    found = rows.select("label", "v").mapInPandas(run, "place long, a double, b double").groupBy("place").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    out = np.zeros((places, 2))
    # As many rows as the open nodes of the trees have sums.
    for r in found.collect():
        out[r["place"]] = r["a"], r["b"]
    return out.reshape(shape)


def _added(place: np.ndarray, weights: list[np.ndarray], places: int) -> np.ndarray:
    return np.stack([np.bincount(place, w, places) for w in weights], 1)


def _ranges(train: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, int]:
    one = train.agg(F.count(F.lit(1)).alias("n"), *[F.min(F.col("v")[i]).alias(f"l{i}") for i in range(dims)],
                    *[F.max(F.col("v")[i]).alias(f"h{i}") for i in range(dims)]).first()
    return (np.array([one[f"l{i}"] or 0.0 for i in range(dims)]), np.array([one[f"h{i}"] or 0.0 for i in range(dims)]), one["n"])


def _dims(train: DataFrame) -> int:
    row = train.select(F.size("v").alias("d")).first()
    return row["d"] if row else 0


def _predictor(spark, trees: Trees, depth: int, dims: int, limit: float) -> Callable[[DataFrame], DataFrame]:
    ship(spark)

    @F.pandas_udf("double")
    def predicted(vectors: pd.Series) -> pd.Series:
        at = trees.leaves(_matrix(vectors, dims), depth)
        return pd.Series((trees.value[np.arange(len(trees.value))[None, :], at].sum(1) > limit).astype(float))

    return lambda df: df.withColumn("prediction", predicted("v"))


# -- extra trees -----------------------------------------------------------------


def extra_trees(train: DataFrame, n: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Callable[[DataFrame], DataFrame]:
    trees, dims = grow_extra_trees(train, n, depth, seed)
    return _predictor(train.sparkSession, trees, depth, dims, len(trees.value) / 2)


def grow_extra_trees(train: DataFrame, n: int, depth: int, seed: int, drawn: list | None = None) -> tuple[Trees, int]:
    """Each open node draws as many features as the root of their number, and one cut for each, evenly between the least
    and greatest value that its path leaves; the cut with the least impurity is taken. All rows grow every tree.

    A leaf's value is its share of label 1. `drawn` takes down (tree, node, feature, cut, sums left, sums of the node).
    """
    ship(train.sparkSession)
    dims, rng = _dims(train), np.random.default_rng(seed)
    low, high, rows = _ranges(train, dims)
    trees, free = Trees.roots(n, depth), [1] * n
    tries = max(1, round(np.sqrt(dims))) if dims else 0
    bounds = {(t, 0): (low, high) for t in range(n)}
    level = list(bounds)
    for step in range(depth + 1):
        cuts = {}
        for key in level:
            l, h = bounds[key]
            able = np.flatnonzero(h > l) if step < depth else np.empty(0, int)
            chosen = rng.choice(able, min(tries, len(able)), replace=False) if len(able) else able
            cuts[key] = [(int(f), float(rng.uniform(l[f], h[f]))) for f in chosen]
        width = max([len(c) for c in cuts.values()], default=0)
        number = np.full(trees.feature.shape, -1)
        feature, cut = np.full((len(level), max(width, 1)), -1), np.zeros((len(level), max(width, 1)))
        for k, key in enumerate(level):
            number[key] = k
            for j, (f, c) in enumerate(cuts[key]):
                feature[k, j], cut[k, j] = f, c
        sums = _sums(train, _counter(trees, number, feature, cut, step), dims, (len(level), max(width, 1) + 1, 2)) if rows else \
            np.zeros((len(level), max(width, 1) + 1, 2))
        following = []
        for k, key in enumerate(level):
            whole, best = sums[k, -1], None
            trees.value[key] = whole[1] / whole[0] if whole[0] else 0.0
            for j, (f, c) in enumerate(cuts[key]):
                left, right = sums[k, j], whole - sums[k, j]
                if drawn is not None:
                    drawn.append((*key, f, c, tuple(left), tuple(whole)))
                if left[0] and right[0] and 0 < whole[1] < whole[0]:
                    impurity = sum(s[1] * (s[0] - s[1]) / s[0] for s in (left, right))
                    if best is None or impurity < best[0]:
                        best = impurity, f, c
            if best:
                child = trees.split(*key, best[1], best[2], free)
                l, h = bounds.pop(key)
                for side, (a, b) in enumerate(((l, np.where(np.arange(dims) == best[1], best[2], h)), (np.where(np.arange(dims) == best[1], best[2], l), h))):
                    bounds[key[0], child + side] = a, b
                    following.append((key[0], child + side))
        level = following
        if not level:
            break
    return trees, dims


def _counter(trees: Trees, number: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int):
    """Rows and labels of each open node: left of each of its cuts, and in all (last)."""
    def add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        nodes, width = feature.shape
        at = number[np.arange(len(number))[None, :], trees.leaves(x, depth)]
        row, tree = np.nonzero(at >= 0)
        node, label = at[row, tree], y[row]
        out = np.zeros((nodes, width + 1, 2))
        out[:, width] = _added(node, [np.ones(len(node)), label], nodes)
        for j in range(width):
            left = (feature[node, j] >= 0) & (x[row, np.maximum(feature[node, j], 0)] < cut[node, j]) if x.shape[1] else np.zeros(len(node), bool)
            out[:, j] = _added(node[left], [np.ones(left.sum()), label[left]], nodes)
        return out

    return add


# -- second-order boosting --------------------------------------------------------


def boosted(train: DataFrame, rounds: int = ROUNDS, depth: int = BOOST_DEPTH) -> Callable[[DataFrame], DataFrame]:
    trees, dims = grow_boosted(train, rounds, depth)
    return _predictor(train.sparkSession, trees, depth, dims, 0.0)


def grow_boosted(train: DataFrame, rounds: int, depth: int) -> tuple[Trees, int]:
    """Each round fits a tree to the first and second derivatives g and h of the logistic loss, whose sums by node,
    feature and bin give the gain of every cut: (left g)^2 / (left h + RIDGE) + the same right, less that of the node. A leaf
    adds -STEP g / (h + RIDGE) to the score of its rows.
    """
    ship(train.sparkSession)
    dims = _dims(train)
    edges = _bin_edges(train, dims)
    trees, free = Trees.roots(rounds, depth), [1] * rounds
    if train.isEmpty():
        return trees, dims
    for t in range(rounds):
        level = [0]
        for step in range(depth + 1):
            number = np.full(trees.feature.shape[1], -1)
            number[level] = np.arange(len(level))
            bins = BINS if step < depth else 1
            sums = _sums(train, _derivatives(trees, t, depth, number, len(level), edges, bins), dims, (len(level), max(dims, 1), bins, 2))
            following = []
            for k, node in enumerate(level):
                g, h = sums[k, 0].sum(0)
                trees.value[t, node] = -STEP * g / (h + RIDGE)
                best = best_cut(sums[k], edges) if step < depth and dims else None
                if best:
                    child = trees.split(t, node, *best, free)
                    following += [child, child + 1]
            level = following
            if not level:
                break
    return trees, dims


def best_cut(sums: np.ndarray, edges: list[np.ndarray]) -> tuple[int, float] | None:
    """(feature, cut) of the greatest gain from sums (feature, bin, (g, h)); None where no cut gains."""
    left = sums.cumsum(1)
    whole = left[:, -1:, :]
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + RIDGE)
    gain = score(left) + score(right) - score(whole)
    gain[np.minimum(left[..., 1], right[..., 1]) < LEAST_WEIGHT - 1e-9] = -np.inf
    feature, place = np.unravel_index(np.argmax(np.round(gain, 9)), gain.shape)
    if not gain[feature, place] > 1e-9:
        return None
    return int(feature), float(edges[feature][place])


def _bin_edges(train: DataFrame, dims: int) -> list[np.ndarray]:
    """Per feature the upper edges of its bins but the last: quantiles, each value once."""
    if not dims:
        return []
    shares = [i / BINS for i in range(1, BINS)]
    row = train.agg(*[F.percentile_approx(F.col("v")[i], shares, 10_000).alias(f"q{i}") for i in range(dims)]).first()
    return [np.unique(np.array(row[f"q{i}"] or [], dtype=float)) for i in range(dims)]


def _derivatives(trees: Trees, t: int, depth: int, number: np.ndarray, nodes: int, edges: list[np.ndarray], bins: int):
    """Sums of g and h by open node of tree `t`, feature and bin; in one bin where only the nodes' sums are asked for."""
    earlier = Trees(trees.feature[:t + 1], trees.cut[:t + 1], trees.child[:t + 1], trees.value[:t + 1])

    def add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = earlier.leaves(x, depth)
        score = earlier.value[np.arange(t)[None, :], at[:, :t]].sum(1)
        p = 1 / (1 + np.exp(-score))
        g, h, node = p - y, p * (1 - p), number[at[:, t]]
        inside = node >= 0
        g, h, node, x = g[inside], h[inside], node[inside], x[inside]
        out = np.zeros((nodes, max(x.shape[1], 1), bins, 2))
        if not x.shape[1]:
            out[:, 0, 0] = _added(node, [g, h], nodes)
        for f in range(x.shape[1]):
            place = np.searchsorted(edges[f], x[:, f], side="right") if bins > 1 else 0
            out[:, f] = _added(node * bins + place, [g, h], nodes * bins).reshape(nodes, bins, 2)
        return out

    return add
