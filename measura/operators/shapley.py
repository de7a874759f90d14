"""Exact Shapley values of tree models, and importances from them and from permuted features.

The game is the path-dependent one: a feature that is not known sends a row down both sides of its splits, weighted by the training rows
there. A leaf's share of a row's values depends only on which of the leaf's features the row agrees with, so each leaf has a table of
``2 ** features on its path`` patterns; rows are looked up in it over Arrow batches. A row's values add up to its prediction less the mean
prediction of the training rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .metrics import regression_metrics
from .splits import digest, position
from .trees import Ensemble, Tree, matrix, usable

#: A leaf's table has two to this power patterns at most.
MOST_ON_PATH = 14
#: Cells of a tree's thresholds, up to which values are looked up by cell.
CELLS = 1 << 14


def model_trees(model, features: list[str], train: DataFrame) -> Ensemble:
    """A fitted tree, forest or boosting model of MLlib, or an ``Ensemble``, with the number of training rows that reach each node.

    The rows are routed once; only counts by node reach the driver."""
    if isinstance(model, Ensemble):
        trees, weights, offset = model.trees, model.weights, model.offset
    else:
        parts = [model] if not hasattr(model, "trees") else model.trees
        weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
        if type(model).__name__.startswith("RandomForest"):
            weights = [w / sum(weights) for w in weights]
        trees, offset = [_read(p._call_java("rootNode")) for p in parts], 0.0
    rows = usable(train.withColumn("__y", F.lit(0.0)), features, "__y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(t.feature), np.int64) for t in trees]
        for b in batches:
            x = matrix(b, 0, len(features))
            for c, t in zip(counts, trees):
                c += np.bincount(t.leaf_of(x), minlength=len(c))
        for k, c in enumerate(counts):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(c[at])], ["tree", "node", "n"])

    for r in rows.mapInArrow(run, "tree long, node long, n long").groupBy("tree", "node").agg(F.sum("n").alias("n")).collect():
        trees[r.tree].cover[r.node] = float(r.n)
    for t in trees:
        for at in range(len(t.feature) - 1, -1, -1):  # children come after their parent
            if t.feature[at] >= 0:
                t.cover[at] = t.cover[t.left[at]] + t.cover[t.right[at]]
    return Ensemble(trees, weights, features, offset)


def _read(root) -> Tree:
    """The nodes of an MLlib tree, which a fitted model holds on the driver."""
    tree, todo = Tree(), [(root, 0)]
    while todo:
        node, at = todo.pop()
        tree.value[at], tree.cover[at] = node.prediction(), 0.0
        if node.numDescendants() if hasattr(node, "numDescendants") else 0:
            split = node.split()
            if split.getClass().getSimpleName() != "ContinuousSplit":
                raise ValueError("trees with categorical splits have no thresholds")
            a, b = tree.split(at, split.featureIndex(), split.threshold())
            todo += [(node.leftChild(), a), (node.rightChild(), b)]
    return tree


class Leaves:
    """The leaves of one tree: on which intervals of which features each lies, and its table of values by pattern."""

    def __init__(self, tree: Tree):
        self.mean, self.leaves = 0.0, []
        stack = [(0, {}, {})]
        while stack:
            at, ranges, shares = stack.pop()
            f = tree.feature[at]
            if f < 0:
                reach = float(np.prod(list(shares.values()))) if shares else 1.0
                self.mean += tree.value[at] * reach
                if shares and tree.value[at]:
                    self.leaves.append((list(shares), [ranges[k] for k in shares], self._table(tree.value[at], list(shares.values()))))
                continue
            low, high = ranges.get(f, (-np.inf, np.inf))
            for kid, span in ((tree.left[at], (low, min(high, tree.threshold[at]))), (tree.right[at], (max(low, tree.threshold[at]), high))):
                # A node that no training row reaches splits evenly, as nothing is known of it.
                share = tree.cover[kid] / tree.cover[at] if tree.cover[at] else 0.5
                stack.append((kid, ranges | {f: span}, shares | {f: shares.get(f, 1.0) * share}))
        self.used = sorted({f for f in tree.feature if f >= 0})
        self.cuts = [np.unique([c for g, c in zip(tree.feature, tree.threshold) if g == f]) for f in self.used]
        self.cells, self.seen, self.by_cell = math.prod(len(c) + 1 for c in self.cuts), 0, None

    @staticmethod
    def _table(value: float, shares: list[float]) -> np.ndarray:
        """For each pattern (bit j: the row agrees on feature j) the leaf's part of each feature's Shapley value."""
        d = len(shares)
        if d > MOST_ON_PATH:
            raise ValueError(f"more than {MOST_ON_PATH} features on one path")
        on = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float)
        size = np.arange(d)
        fact = np.concatenate([[1.0], np.cumprod(np.arange(1.0, d + 1))])
        weight = fact[size] * fact[d - 1 - size] / fact[d]
        out = np.zeros((1 << d, d))
        for i in range(d):
            # Coefficients by the number of known features: the product of (share + agrees * t) over the other features.
            poly = np.zeros((1 << d, d))
            poly[:, 0] = 1.0
            for j in range(d):
                if j != i:
                    more = np.zeros_like(poly)
                    more[:, 1:] = poly[:, :-1] * on[:, j:j + 1]
                    poly = poly * shares[j] + more
            out[:, i] = value * (on[:, i] - shares[i]) * (poly @ weight)
        return out

    def add(self, x: np.ndarray, into: np.ndarray, weight: float) -> None:
        """Rows between the same thresholds have the same values: once there were more rows than such cells, they are looked up by cell."""
        self.seen += len(x)
        if self.by_cell is None and self.cells <= min(CELLS, self.seen):
            ends = np.meshgrid(*(np.append(c, np.inf) for c in self.cuts), indexing="ij")
            points, self.by_cell = np.zeros((self.cells, into.shape[1])), np.zeros((self.cells, into.shape[1]))
            points[:, self.used] = np.stack([e.ravel() for e in ends], axis=1) if ends else 0.0
            self._add(points, self.by_cell, 1.0)
        if self.by_cell is None:
            return self._add(x, into, weight)
        cell = np.zeros(len(x), int)
        for f, c in zip(self.used, self.cuts):
            cell = cell * (len(c) + 1) + np.searchsorted(c, x[:, f])
        into += weight * self.by_cell[cell]

    def _add(self, x: np.ndarray, into: np.ndarray, weight: float) -> None:
        for features, ranges, table in self.leaves:
            code = np.zeros(len(x), int)
            for j, (f, (low, high)) in enumerate(zip(features, ranges)):
                code |= ((x[:, f] > low) & (x[:, f] <= high)).astype(int) << j
            into[:, features] += weight * table[code]


def shapley_values(model: Ensemble, df: DataFrame, prediction: str = "yhat", values: str = "shapley", mean: str = "mean") -> DataFrame:
    """``df`` with the prediction, the training mean of predictions, and an array of the features' Shapley values, in the features' order."""
    trees = [Leaves(t) for t in model.trees]
    base = model.offset + sum(w * t.mean for w, t in zip(model.weights, trees))
    out, n = f"struct<p: double, v: array<double>>", len(model.features)

    @F.pandas_udf(out)
    def explain(x):
        import pandas as pd

        m = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, n))
        v = np.zeros((len(m), n))
        for w, t in zip(model.weights, trees):
            t.add(m, v, w)
        return pd.DataFrame({"p": model.values(m), "v": list(v)})

    got = df.na.drop(subset=model.features).withColumn("__s", explain(F.array(*(F.col(c).cast("double") for c in model.features))))
    return got.withColumns({prediction: F.col("__s.p"), mean: F.lit(float(base)), values: F.col("__s.v")}).drop("__s")


def _placed(found: DataFrame, by: str) -> DataFrame:
    """Places by importance; one row for each feature, ties by name."""
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.col(by).desc(), "feature")).cast("int"))


def shapley_ranking(model: Ensemble, df: DataFrame) -> DataFrame:
    """(feature, importance, place): the mean absolute Shapley value over all rows, and its place."""
    long = shapley_values(model, df).select(F.posexplode("shapley").alias("k", "v"))
    found = long.groupBy("k").agg(F.avg(F.abs("v")).alias("importance"))
    return _placed(found.select(F.element_at(F.lit(model.features), F.col("k") + 1).alias("feature"), "importance"), "importance")


def permutation_importance(fitted, df: DataFrame, key: str, label: str, seed: int = 7) -> DataFrame:
    """(feature, r2, permuted_r2, importance, place): what the model's r2 loses when one feature is shuffled.

    A shuffled feature is another row's: rows in one digest order meet those in the feature's own order by their places."""
    rows = written(df.select(key, *fitted.features, label).na.drop(), "permuted")
    base = regression_metrics(fitted.predict(rows), label, "yhat").select("r2")
    at = written(position(rows, digest(seed, key), "__p", tie=key), "permuted")
    parts = None
    for c in fitted.features:
        other = position(rows.select(key, c), digest(f"{seed}:{c}", key), "__p", tie=key).select("__p", c)
        one = fitted.predict(at.drop(c).join(other, "__p")).select(F.lit(c).alias("feature"), label, "yhat")
        parts = one if parts is None else parts.unionByName(one)
    got = regression_metrics(parts, label, "yhat", ["feature"]).select("feature", F.col("r2").alias("permuted_r2"))
    got = got.join(F.broadcast(base)).select("feature", "r2", "permuted_r2", (F.col("r2") - F.col("permuted_r2")).alias("importance"))  # one row
    return _placed(got, "importance")
