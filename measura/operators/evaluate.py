"""Cross-validation and comparison.

A validation gives the predictions for each test fold, (model, fold, key, y, yhat); ``repeated`` runs one over several foldings."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written
from . import linear
from .joins import parent_folds
from .metrics import fold_summary, leaderboard, regression_metrics
from .mixtures import Mixtures, bagged_trees, moved
from .models import LINEAR, Fitted, Spec, hierarchical, stack, two_stage
from .prep import Components, PowerScaler, impute, medians
from .splits import k_folds


def _tested(got: DataFrame, name: str, fold: int, key: str, label: str) -> DataFrame:
    return got.select(F.lit(name).alias("model"), F.lit(fold).alias("fold"), key, F.col(label).alias("y"), "yhat")


def repeated(df: DataFrame, key: str, k: int, repeats: int, run: Callable[[DataFrame], DataFrame], seed: int = 42) -> DataFrame:
    """``run``, a validation of a table with folds, over ``repeats`` foldings that each have an order of their own.

    Folds are numbered on, repeat * k + fold, so a summary by fold is one over all folds of all repeats. Each folded table is written
    once, as every fit reads it."""
    parts = []
    for r in range(repeats):
        folded = written(k_folds(df.drop("fold"), key, k, seed + r, True), "folds")
        parts.append(run(folded).withColumn("fold", F.col("fold") + r * k))
    return reduce(DataFrame.unionByName, parts)


def cross_validate(df: DataFrame, spec: Spec, features: list[str], label: str, k: int, key: str, fold: str = "fold", name: str = "model") -> DataFrame:
    """(model, fold, key, y, yhat): predictions for each test fold (M14). Everything else is an aggregate of this table."""
    if spec.kind in LINEAR and features:
        found = linear.sums(df, features, label, [fold], spec.weight)
        return _by_fold(df, [spec.solve(_others(found, f), len(features)) for f in range(k)], features, label, key, fold, name)
    rows = written(df, "folds") if k > 1 else df  # every fit reads them
    parts = []
    for f in range(k):
        got = spec.fit(rows.where(F.col(fold) != f), features, label).predict(rows.where(F.col(fold) == f))
        parts.append(_tested(got, name, f, key, label))
    return reduce(DataFrame.unionByName, parts)


def fold_fits(df: DataFrame, spec: Spec, features: list[str], label: str, k: int, fold: str = "fold") -> list[Fitted]:
    """The model of each fold, fitted on the rows of the others; all linear ones from one pass."""
    if spec.kind in LINEAR and features:
        found = linear.sums(df, features, label, [fold], spec.weight)
        return [Fitted(spec.solve(_others(found, f), len(features)), features) for f in range(k)]
    return [spec.fit(df.where(F.col(fold) != f), features, label) for f in range(k)]


def _others(found: dict[tuple, linear.Sums], fold: int) -> linear.Sums | None:
    """The sums of all folds but one."""
    return linear.total([s for g, s in found.items() if g[0] != fold])


def _by_fold(df: DataFrame, models: list[linear.Linear], features: list[str], label: str, key: str, fold: str, name: str) -> DataFrame:
    """Each row's prediction by its fold's model, in one pass."""
    rows = df.na.drop(subset=features).where(F.col(fold).between(0, len(models) - 1))
    return rows.select(F.lit(name).alias("model"), F.col(fold).cast("int").alias("fold"), key, F.col(label).alias("y"), linear.fold_column(models, features, fold).alias("yhat"))


def search_space(grid: dict[str, list], tries: int, seed: int = 0) -> list[dict]:
    """Random points of a grid, each at most once."""
    points = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]
    return random.Random(seed).sample(points, min(tries, len(points)))


def nested_cv(df: DataFrame, kind: str, grid: dict[str, list], features: list[str], label: str, key: str, k: int, tries: int = 3, inner: int = 2, seed: int = 0) -> tuple[DataFrame, list[dict]]:
    """Outer folds in column ``fold``; inside each a random search by inner folds (column ``inner``), a refit, and the test.

    For repeated outer folds: ``repeated(df, key, k, repeats, lambda folded: nested_cv(folded, ...)[0])``."""
    if kind in LINEAR:
        return _nested_from_sums(df, kind, grid, features, label, key, k, tries, inner, seed)
    parts, chosen = [], []
    for f in range(k):
        train = df.where(F.col("fold") != f).cache()
        best = None
        for point in search_space(grid, tries, seed + f):
            got = cross_validate(train, Spec(kind, point), features, label, inner, key, "inner")
            score = regression_metrics(got, "y", "yhat").first().r2
            if best is None or score > best[0]:
                best = (score, point)
        chosen.append(best[1])
        got = Spec(kind, best[1]).fit(train, features, label).predict(df.where(F.col("fold") == f))
        parts.append(_tested(got, kind, f, key, label))
        train.unpersist()
    return reduce(DataFrame.unionByName, parts), chosen


def _nested_from_sums(df: DataFrame, kind: str, grid: dict[str, list], features: list[str], label: str, key: str, k: int, tries: int, inner: int, seed: int) -> tuple[DataFrame, list[dict]]:
    """Nested validation of a linear model: the sums by fold and inner fold give every fit and every inner score."""
    found = linear.sums(df, features, label, ["fold", "inner"])
    models, chosen = [], []
    for f in range(k):
        own = {g: s for g, s in found.items() if g[0] != f}
        scores = []
        for point in search_space(grid, tries, seed + f):
            spec, tested, error = Spec(kind, point), [], 0.0
            for i in range(inner):
                held = linear.total([s for g, s in own.items() if g[1] == i])
                if held is not None:
                    m = spec.solve(linear.total([s for g, s in own.items() if g[1] != i]), len(features))
                    error += held.squared_error(m.weights, m.intercept)
                    tested.append(held)
            every = linear.total(tested)
            spread = every.label_variation()[1] if every is not None else 0.0
            scores.append((1 - error / spread if spread > 0 else 0.0, point))
        best = max(scores, key=lambda x: x[0])[1]  # the first of equal ones
        chosen.append(best)
        models.append(Spec(kind, best).solve(linear.total(list(own.values())), len(features)))
    return _by_fold(df, models, features, label, key, "fold", kind), chosen


def holdout(df: DataFrame, spec: Spec, features: list[str], label: str, split: str = "split") -> DataFrame:
    """Train and test metrics of one split."""
    fitted = spec.fit(df.where(F.col(split) == "train"), features, label)
    return regression_metrics(fitted.predict(df), label, "yhat", [split])


def compare(df: DataFrame, entries: list[tuple[str, Spec, list[str]]], label: str, k: int, key: str) -> DataFrame:
    """Ranked cross-validated entries (M16): models, feature subsets, parameter sweeps and layers all are lists of entries."""
    used = sorted({c for _, spec, features in entries for c in [*features, *([spec.weight] if spec.weight else []), *([spec.validation] if spec.validation else [])]} | {label, key, "fold"})
    rows = written(df.select(*used), "compared")  # every entry reads them
    got = reduce(DataFrame.unionByName, (cross_validate(rows, spec, features, label, k, key, name=name) for name, spec, features in entries))
    order = F.lit(None).cast("int")
    for i, (name, _, _) in enumerate(entries):
        order = F.when(F.col("model") == name, i).otherwise(order)
    return leaderboard(fold_summary(got, "y", "yhat").withColumn("config_order", order))


def hierarchical_cv(df: DataFrame, groups: list[list[str]], label: str, k: int, key: str, last: Spec | None = None, name: str = "hierarchical") -> DataFrame:
    """Validation of the hierarchical model: all its stages are fitted in each fold."""
    return reduce(DataFrame.unionByName, (
        _tested(hierarchical(df.where(F.col("fold") != f), df.where(F.col("fold") == f), groups, label, last), name, f, key, label) for f in range(k)))


def committee_cv(df: DataFrame, experts: dict[str, tuple[Spec, list[str]]], label: str, k: int, key: str, raw: list[str] | None = None, components: dict[str, tuple[list[str], int]] | None = None,
                 inner: int = 2, meta: Spec | None = None, name: str = "committee") -> DataFrame:
    """Validation of an expert committee (M11). In each fold, on its training rows alone: principal components, ``components`` by prefix as
    (columns, number) that experts may name as prefix0, prefix1, ...; medians for what is missing; power scaling; experts by inner folds
    (column ``inner``) for the meta-model, and once more on all training rows for the test."""
    parts = []
    for f in range(k):
        train, test = df.where(F.col("fold") != f), df.where(F.col("fold") == f)
        made: set[str] = set()
        for prefix, (columns, n) in (components or {}).items():
            fitted = Components.fit(train, columns, n)
            train, test = fitted.transform(train, prefix), fitted.transform(test, prefix)
            made |= {f"{prefix}{i}" for i in range(len(fitted.explained))}
        if components:
            train = written(train, "components")  # medians, scaler and training rows read them
        # Fewer rows than components leave fewer columns.
        own = {e: (spec, [c for c in columns if c in made or c in df.columns]) for e, (spec, columns) in experts.items()}
        used = sorted({c for _, columns in own.values() for c in columns} | set(raw or []))
        fill = medians(train, used)
        train, test = impute(train, fill), impute(test, fill)
        scaler = PowerScaler.fit(train, used)
        train, test = written(scaler.transform(train), "committee"), scaler.transform(test)
        _, judge = stack(train, own, label, inner, raw, meta or Spec("elastic", {"alpha": 0.1, "mix": 0.5}), "inner")
        for e, (spec, columns) in own.items():
            test = spec.fit(train, columns, label).predict(test, f"oof_{e}")
        parts.append(_tested(judge.predict(test), name, f, key, label))
    return reduce(DataFrame.unionByName, parts)


def weighted_cv(gold: DataFrame, others: list[tuple[DataFrame, float]], spec: Spec, features: list[str], label: str, k: int, key: str, scale: bool = True, name: str = "weighted") -> DataFrame:
    """Gold rows in folds with weight 1, other sources always in training with their weight; tested on gold only.

    The power scaler is fitted on all rows that the fold trains on. Sources of weight 0 are left out."""
    return _weighted(gold, [df for df, _ in others], [(name, [w for _, w in others])], spec, features, label, k, key, scale)


def _weighted(gold: DataFrame, others: list[DataFrame], scans: list[tuple[str, list[float]]], spec: Spec, features: list[str], label: str, k: int, key: str, scale: bool) -> DataFrame:
    """``weighted_cv`` for several (name, weights). A fold's scaler does not read the weights, so one fits all scans with the same sources; and
    the sums by source give all linear models of a fold from one pass."""
    parts: list[list[DataFrame]] = [[] for _ in scans]
    for f in range(k):
        own, held = gold.where(F.col("fold") != f).select(*features, label), gold.where(F.col("fold") == f)
        made: dict[tuple, tuple] = {}
        for (name, weights), out in zip(scans, parts):
            used = tuple(i for i, w in enumerate(weights) if w > 0)
            if used not in made:
                train, test = own.withColumn("__source", F.lit(-1)), held
                for i in used:
                    train = train.unionByName(others[i].select(*features, label).withColumn("__source", F.lit(i)))
                if scale:
                    scaler = PowerScaler.fit(train, features)
                    train, test = scaler.transform(train), scaler.transform(test)
                made[used] = train, test, linear.sums(train, features, label, ["__source"]) if spec.kind in LINEAR and features else None
            train, test, found = made[used]
            of = {-1: 1.0} | {i: float(weights[i]) for i in used}
            if found is not None:
                fitted = Fitted(spec.solve(linear.total([s.times(of[g[0]]) for g, s in found.items()]), len(features)), features)
            else:
                weight = reduce(lambda c, i: F.when(F.col("__source") == i, of[i]).otherwise(c), used, F.lit(1.0))
                fitted = Spec(spec.kind, spec.params, "weight", spec.validation).fit(train.withColumn("weight", weight).drop("__source"), features, label)
            out.append(_tested(fitted.predict(test), name, f, key, label))
    return reduce(DataFrame.unionByName, [part for out in parts for part in out])


def weight_scan(gold: DataFrame, others: dict[str, DataFrame], weights: list[float], features: list[str], label: str, k: int, key: str, kind: str = "ridge", scale: bool = True) -> DataFrame:
    """The summary of ``weighted_cv`` for each weight (M07). ``best`` marks the highest mean r2 above 0, the earlier weight of equal ones."""
    got = _weighted(gold, list(others.values()), [(f"w={w}", [w] * len(others)) for w in weights], Spec(kind), features, label, k, key, scale)
    place = F.lit(None).cast("int")
    for i, w in enumerate(weights):
        place = F.when(F.col("model") == f"w={w}", i).otherwise(place)
    table = fold_summary(got, "y", "yhat").withColumn("__i", place)
    top = table.where("r2_mean > 0").agg(F.max_by("__i", F.struct("r2_mean", -F.col("__i"))).alias("__b"))  # one row
    return table.join(F.broadcast(top)).withColumn("best", F.col("__i").eqNullSafe(F.col("__b"))).drop("__i", "__b")


def leak_free_cv(gold: DataFrame, virtual: DataFrame, spec: Spec, features: list[str], label: str, k: int, key: str, weight: float | None = None,
                 trees: tuple[int, int] | None = None, scale: bool = False) -> DataFrame:
    """Cross-validation with virtual rows whose parents are not in the fold's test set, and without any.

    ``virtual`` rows train like gold ones; a further model ``weighted`` gives them ``weight`` (M07), and one ``two_stage`` grows the first
    of its (first, total) ``trees`` on them (M08). With ``scale``, the power scaler is fitted on all rows that a model trains on.

    ``virtual`` may bring its parents' folds as fold1 and fold2; else they are looked up. A linear model without ``scale`` is solved from the
    sums by the two folds, one pass over the virtual rows for all folds and models; with it, from one pass for each fold."""
    if not {"fold1", "fold2"} <= set(virtual.columns):
        virtual = parent_folds(virtual, gold.select(F.col(key).alias("key"), "fold"))
    linear_one = spec.kind in LINEAR
    # No row belongs to fold -1: parents without a fold are in no test set.
    columns = [*features, label]
    rows = gold.where("fold is not null").select(F.lit(0).alias("virtual"), F.col("fold").alias("fold1"), F.col("fold").alias("fold2"), *columns)
    rows = rows.unionByName(virtual.select(F.lit(1).alias("virtual"), *(F.coalesce(F.col(c), F.lit(-1)).alias(c) for c in ("fold1", "fold2")), *columns))
    every = linear.sums(rows, features, label, ["virtual", "fold1", "fold2"]) if linear_one and not scale else {}
    parts = []
    for f in range(k):
        own, test = gold.where(F.col("fold") != f).select(*columns), gold.where(F.col("fold") == f)
        free = rows.where((F.col("fold1") != f) & (F.col("fold2") != f))
        both, more = free.select("virtual", *columns), free.where("virtual = 1").select(*columns)

        def tell(name: str, found: list[linear.Sums], at: DataFrame) -> None:
            model = spec.solve(linear.total(found), len(features))
            parts.append(_tested(at.na.drop(subset=features).withColumn("yhat", model.column(features)), name, f, key, label))

        baseline, mixed = (PowerScaler.fit(df, features).transform if scale else (lambda df: df) for df in (own, both))
        if linear_one:
            if scale:
                tell("baseline", list(linear.sums(baseline(own), features, label).values()), baseline(test))
                found = linear.sums(mixed(both), features, label, ["virtual"])
            else:
                found = {}
                for (v, a, b), s in every.items():
                    if f not in (a, b):
                        found[(v,)] = found[(v,)] + s if (v,) in found else s
                tell("baseline", [s for g, s in found.items() if g == (0,)], test)
            tell("virtual", list(found.values()), mixed(test))
            if weight is not None:
                tell("weighted", [s.times(weight) if g == (1,) else s for g, s in found.items()], mixed(test))
        else:
            parts.append(_tested(spec.fit(baseline(own), features, label).predict(baseline(test)), "baseline", f, key, label))
            parts.append(_tested(spec.fit(mixed(both), features, label).predict(mixed(test)), "virtual", f, key, label))
            if weight is not None:
                weighed = mixed(both).withColumn("weight", F.when(F.col("virtual") == 1, float(weight)).otherwise(1.0))
                parts.append(_tested(Spec(spec.kind, spec.params, "weight").fit(weighed, features, label).predict(mixed(test)), "weighted", f, key, label))
        if trees is not None:
            parts.append(_tested(two_stage(mixed(more), mixed(own), mixed(test), features, label, *trees), "two_stage", f, key, label))
    return reduce(DataFrame.unionByName, parts)


def leak_free_mixtures(gold: DataFrame, weights: list[float], spec: Spec, feature: str, label: str, k: int, key: str, weight: float | None = None,
                       trees: tuple[int, int] | None = None, scale: bool = False, seed: int = 1) -> DataFrame:
    """``leak_free_cv`` of a linear model on one feature, where the virtual rows are the mixtures of all pairs of gold rows at ``weights``: their
    features mix in proportion, their labels harmonically (J05). The mixtures are summed as they are made, and have no rows.

    Sums give the linear models and the power scalers; trees on mixtures are grown from sums by bin of the feature and bagged by bin."""
    if spec.kind not in LINEAR or (trees is not None and not scale):
        raise ValueError("a linear model, and trees with scale only")
    made, parts = Mixtures(gold, key, feature, label, weights, k), []
    if scale:
        cells = made.by_cell()
        scalers = cells.scalers(gold, feature)
        virtual = cells.scaled(scalers, feature)
    else:
        every = linear.sums(gold, [feature], label, ["fold"])
        shift = next(iter(every.values())).shift if every else [0.0, 0.0]
        virtual = made.sums(shift)
    for f in range(k):
        own, test = gold.where(F.col("fold") != f).select(feature, label), gold.where(F.col("fold") == f)

        def tell(name: str, found: list[linear.Sums], at: DataFrame) -> None:
            model = spec.solve(linear.total(found), 1)
            parts.append(_tested(at.na.drop(subset=[feature]).withColumn("yhat", model.column([feature])), name, f, key, label))

        def summed(df: DataFrame) -> list[linear.Sums]:
            return list(linear.sums(df, [feature], label).values())

        if scale:
            alone, mixed = PowerScaler.fit(own, [feature]), scalers[f]
            tell("baseline", summed(alone.transform(own)), alone.transform(test))
            real, at = summed(mixed.transform(own)), mixed.transform(test)
        else:
            real, at = [s for g, s in every.items() if g[0] != f], test
            tell("baseline", real, test)
        more = [moved(virtual[f], real[0].shift) if real else virtual[f]] if virtual[f] is not None else []
        tell("virtual", real + more, at)
        if weight is not None:
            tell("weighted", real + [s.times(weight) for s in more], at)
        if trees is not None:
            first, total = trees
            cuts, bins = cells.bins(f)
            a = bagged_trees(bins, cuts, feature, first, seed + f)
            b = Spec("forest", {"numTrees": total - first}).fit(mixed.transform(own), [feature], label, "b")
            both = b.predict(mixed.transform(a.predict(test, "a")))
            parts.append(_tested(both.withColumn("yhat", (first * F.col("a") + (total - first) * F.col("b")) / total), "two_stage", f, key, label))
    return reduce(DataFrame.unionByName, parts)
