"""Gradient boosting with squared and pinball loss, and under sign constraints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written
from .quantiles import quantiles
from .trees import Ensemble, group_quantiles, grow, quantile_thresholds, usable


def boosted_trees(df: DataFrame, features: list[str], label: str, stages: int = 10, rate: float = 0.1, depth: int = 3, least: float = 5, bins: int = 32,
                  signs: dict[str, int] | None = None, weight: str | None = None) -> Ensemble:
    """Boosting with squared loss. Features with a sign in ``signs`` are monotone: no prediction falls (1) or rises (-1) as they grow.

    Each tree is fitted to what the trees before it leave over; tasks compute that from the trees, so no stage adds to the lineage."""
    rows = written(usable(df, features, label, weight), "boosting")
    own = rows.agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("m")).first().m
    edges = quantile_thresholds(rows, [f"f{k}" for k in range(len(features))], bins)
    model = Ensemble([], [], features, float(own or 0.0))
    for _ in range(stages):
        model.trees += grow(rows, features, 1, depth, least, edges=edges, signs=signs, target=_left_over(model))
        model.weights.append(rate)
    return model


def _left_over(model: Ensemble):
    return lambda x, y: [y - model.values(x)]


def quantile_boosting(df: DataFrame, features: list[str], label: str, levels: list[float], stages: int = 10, rate: float = 0.3, depth: int = 3, least: float = 20, bins: int = 32) -> list[Ensemble]:
    """A model of each quantile level by boosting with pinball loss.

    The start is the label's own quantile. Each stage fits a tree to the loss's negative gradient (level above the prediction, level - 1
    below it) and then refits its leaves: a leaf gets the exact quantile of what is left over in it, found by counts of ranges however
    large the leaf. The trees of all levels grow in the same jobs."""
    rows = written(usable(df, features, label), "boosting")
    edges = quantile_thresholds(rows, [f"f{k}" for k in range(len(features))], bins)
    start = quantiles(rows, "y", [float(q) for q in levels]).first()
    models = [Ensemble([], [], features, float(start["__q"][m]) if start else 0.0) for m in range(len(levels))]

    def signs_of(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        return [np.where(y > model.values(x), q, q - 1) for q, model in zip(levels, models)]

    for _ in range(stages if start else 0):
        trees = grow(rows, features, len(levels), depth, least, edges=edges, target=signs_of)
        # Leaves of all trees are numbered on: a row is in one leaf of each.
        first = np.cumsum([0, *(len(t.feature) for t in trees)])

        def left_over(x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            return [(a + tree.leaf_of(x), y - model.values(x)) for a, model, tree in zip(first, models, trees)]

        found = group_quantiles(rows, len(features), left_over, lambda g: levels[int(np.searchsorted(first, g, side="right")) - 1])
        for g, value in found.items():
            m = int(np.searchsorted(first, g, side="right")) - 1
            trees[m].value[g - first[m]] = value
        for model, tree in zip(models, trees):
            model.trees.append(tree)
            model.weights.append(rate)
    return models


def pinball_loss(y, yhat, level: float):
    """Mean pinball loss as a Column: what a quantile model minimises."""
    d = F.col(y) - F.col(yhat)
    return F.avg(F.greatest(level * d, (level - 1) * d))
