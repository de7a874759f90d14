"""Regressors and training schemes."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .boosting import boosted_trees
from .trees import Ensemble, random_trees

VECTOR = "__features"
LINEAR = ("ridge", "lasso", "elastic")


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature vector; rows with a missing feature are left out, as a vector has no NULLs."""
    return VectorAssembler(inputCols=features, outputCol=VECTOR, handleInvalid="skip").transform(df.drop(VECTOR))


@dataclass
class Spec:
    """A model by kind and parameters; ``weight`` names a weight column, ``validation`` a boolean column for early stopping.

    ``ridge``, ``lasso`` and ``elastic`` are solved from sums (see ``linear.solve`` for their objectives)."""

    kind: str = "ridge"
    params: dict = field(default_factory=dict)
    weight: str | None = None
    validation: str | None = None

    def fit(self, train: DataFrame, features: list[str], label: str, prediction: str = "yhat"):
        p = dict(self.params)
        if self.kind in ("random_trees", "signed_boosting"):  # M06, A24: trees grown by aggregates
            grow = random_trees if self.kind == "random_trees" else boosted_trees
            return Fitted(grow(train, features, label, weight=self.weight, **p), features, prediction)
        if self.kind in LINEAR:
            found = linear.sums(train, features, label, weight=self.weight)
            return Fitted(self.solve(found.get((), None), len(features)), features, prediction)
        common = {"featuresCol": VECTOR, "labelCol": label, "predictionCol": prediction} | ({"weightCol": self.weight} if self.weight else {})
        rows = assemble(train.where(F.col(label).isNotNull()), features)
        if self.kind == "tree":
            est = DecisionTreeRegressor(**({"maxDepth": 5, "seed": 1} | p), **common)
        elif self.kind == "forest":
            est = RandomForestRegressor(**({"numTrees": 20, "maxDepth": 5, "seed": 1} | p), **common)
        elif self.kind == "random_features":  # M06: no bagging, few features for each split; thresholds are not random
            est = RandomForestRegressor(**({"numTrees": 20, "maxDepth": 5, "seed": 1, "bootstrap": False, "featureSubsetStrategy": "sqrt"} | p), **common)
        elif self.kind == "boosting":
            extra = {"validationIndicatorCol": self.validation} if self.validation else {}
            est = GBTRegressor(**({"maxIter": 10, "maxDepth": 3, "seed": 1} | p), **extra, **common)
        else:
            raise ValueError(f"unknown model {self.kind}")
        return Fitted(est.fit(rows), features, prediction)

    def solve(self, found: linear.Sums | None, n: int) -> linear.Linear:
        """A linear model from the sums of its training rows."""
        if found is None:
            return linear.Linear(np.zeros(n), 0.0)
        p = self.params
        alpha = p.get("alpha", 1.0 if self.kind == "ridge" else 0.01)
        return linear.solve(found, self.kind, alpha, p.get("mix", 0.5), p.get("per_row", False))


@dataclass
class Fitted:
    model: object
    features: list[str]
    prediction: str = "yhat"

    def predict(self, df: DataFrame, name: str | None = None) -> DataFrame:
        if isinstance(self.model, Ensemble):
            return self.model.predict(df, name or self.prediction)
        if isinstance(self.model, linear.Linear):
            return df.na.drop(subset=self.features).withColumn(name or self.prediction, self.model.column(self.features))
        out = self.model.transform(assemble(df, self.features)).drop(VECTOR)
        return out.withColumnRenamed(self.prediction, name) if name and name != self.prediction else out

    def importance(self) -> dict[str, float]:
        """Tree importances, or absolute coefficients."""
        if isinstance(self.model, Ensemble):
            return self.model.importance()
        values = self.model.featureImportances if hasattr(self.model, "featureImportances") else self.model.coefficients
        return {c: abs(float(values[k])) for k, c in enumerate(self.features)}


def with_weights(parts: dict[str, tuple[DataFrame, float]], columns: list[str]) -> DataFrame:
    """The union of sources with a weight column."""
    out = None
    for name, (df, weight) in parts.items():
        one = df.select(*columns).withColumns({"weight": F.lit(float(weight)), "origin": F.lit(name)})
        out = one if out is None else out.unionByName(one)
    return out


def two_stage(virtual: DataFrame, gold: DataFrame, test: DataFrame, features: list[str], label: str, first: int, total: int, **params) -> DataFrame:
    """``first`` trees on virtual rows and the rest on gold rows; the prediction is the mean of all trees."""
    a = Spec("forest", {"numTrees": first} | params).fit(virtual, features, label, "a")
    b = Spec("forest", {"numTrees": total - first} | params).fit(gold, features, label, "b")
    both = b.predict(a.predict(test))
    return both.withColumn("yhat", (first * F.col("a") + (total - first) * F.col("b")) / total)


def out_of_fold(df: DataFrame, specs: dict[str, tuple[Spec, list[str]]], label: str, k: int, fold: str = "fold") -> DataFrame:
    """Predictions of each named model for rows it was not trained on, as columns."""
    parts = None
    for f in range(k):
        train, test = df.where(F.col(fold) != f), df.where(F.col(fold) == f)
        for name, (spec, features) in specs.items():
            test = spec.fit(train, features, label).predict(test, f"oof_{name}")
        parts = test if parts is None else parts.unionByName(test)
    return parts


def stack(df: DataFrame, specs: dict[str, tuple[Spec, list[str]]], label: str, k: int, raw: list[str] | None = None, meta: Spec | None = None, fold: str = "fold") -> tuple[DataFrame, Fitted]:
    """Out-of-fold predictions, some raw features beside them, and the meta-model fitted on both."""
    oof = out_of_fold(df, specs, label, k, fold)
    columns = [f"oof_{n}" for n in specs] + list(raw or [])
    return oof, (meta or Spec("ridge", {"alpha": 1.0})).fit(oof, columns, label)


def hierarchical(train: DataFrame, test: DataFrame, groups: list[list[str]], label: str, last: Spec | None = None) -> DataFrame:
    """Ridge on group 0, boosted trees on what is left over with each further group, then with all.

    Columns part0, part1, ... and yhat, their sum. A group without columns adds the mean at first and nothing later."""
    every = [c for g in groups for c in g]
    stages = [*groups, every] if len(groups) > 1 else groups
    parts = []
    train = train.withColumn("__rest", F.col(label).cast("double"))
    for k, features in enumerate(stages):
        name = f"part{k}"
        parts.append(name)
        if features:
            spec = Spec("ridge", {"alpha": 1.0}) if k == 0 else last or Spec("boosting", {"maxIter": 5})
            fitted = spec.fit(train, features, "__rest", name)
            train, test = fitted.predict(train), fitted.predict(test)
        else:
            mean = train.agg(F.avg("__rest")).first()[0] if k == 0 else 0.0
            train, test = train.withColumn(name, F.lit(mean)), test.withColumn(name, F.lit(mean))
        train = train.withColumn("__rest", F.col("__rest") - F.col(name)).drop(name)
    return test.withColumn("yhat", sum((F.col(p) for p in parts), F.lit(0.0)))
