"""Conformal prediction intervals."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written
from .boosting import quantile_boosting
from .evaluate import fold_fits
from .metrics import conformal_quantile
from .models import VECTOR, Spec, assemble
from .quantiles import meet
from .quantiles import quantiles as quantiles_of
from .ranks import placed


def split_conformal(train: DataFrame, calibration: DataFrame, test: DataFrame, spec: Spec, features: list[str], label: str, coverage: float = 0.9) -> DataFrame:
    """yhat -+ q, q from the calibration residuals."""
    fitted = spec.fit(train, features, label)
    q = conformal_quantile(fitted.predict(calibration), F.col(label) - F.col("yhat"), coverage).select("q")
    got = fitted.predict(test).join(F.broadcast(q))
    return got.withColumns({"low": F.col("yhat") - F.col("q"), "high": F.col("yhat") + F.col("q")}).drop("q")


#: Distinct residuals of one range, ranges of one fold, and test rows of one group that meets the same ranges.
FEW, MOST_RANGES, CHUNK = 64, 100_000, 250_000


def cross_conformal(df: DataFrame, test: DataFrame, spec: Spec, features: list[str], label: str, key: str, k: int, coverage: float = 0.9, levels: int = 1_000) -> DataFrame:
    """Bounds are quantiles of (a fold model's prediction -+ a residual of that fold) over all folds and residuals.

    Exact. Each fold's residuals are counted by value, placed in order and cut into ``levels`` ranges or more, of ``FEW`` values each. The
    ranges' ends and counts (all that the driver and all tasks hold, up to ``MOST_RANGES`` for each fold) tell which few ranges can hold a
    test row's wanted places. Rows that want the same ranges meet these ranges' residuals once, ``CHUNK`` rows at a time at most."""
    fits = fold_fits(df, spec, features, label, k)
    residuals = [fitted.predict(df.where(F.col("fold") == f)).select(F.lit(f).alias("fold"), F.abs(F.col(label) - F.col("yhat")).alias("r")) for f, fitted in enumerate(fits)]
    counts = written(reduce(DataFrame.unionByName, residuals).where("r is not null").groupBy("fold", "r").agg(F.count(F.lit(1)).alias("n")), "residuals")
    widths = [1] * k
    for x in counts.groupBy("fold").agg(F.count(F.lit(1)).alias("m")).collect():
        widths[x.fold] = max(1, min(x.m // levels, FEW), -(-x.m // MOST_RANGES))
    at_range = F.floor(F.col("__place") / F.element_at(F.lit(widths), F.col("fold") + 1)).alias("range")
    parts = placed(counts, ["r"], "__place", ["fold"]).groupBy("fold", at_range).agg(F.array_sort(F.collect_list(F.struct("r", "n"))).alias("__x"))  # a range's few values
    parts = written(parts.select("fold", "range", F.col("__x.r").alias("r"), F.col("__x.n").alias("n")), "ranges")
    total = F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")
    ends = parts.select("fold", "range", F.element_at("r", 1).alias("low"), F.element_at("r", -1).alias("high"), total).toArrow().sort_by([("fold", "ascending"), ("range", "ascending")])
    every = test
    for f, fitted in enumerate(fits):
        every = fitted.predict(every).withColumnRenamed("yhat", f"__y{f}")
    yhat = [F.col(f"__y{f}") for f in range(k)]
    # Rows of one key and label have the same bounds and come once.
    every = every.groupBy(key, F.col(label).alias("y")).agg(F.array(*(F.first(c) for c in yhat)).alias("__p"), F.avg(sum(yhat) / k).alias("yhat"))
    none = [F.lit(None).cast("double").alias(c) for c in ("low", "high")]
    if not len(ends):
        return every.select(key, "y", "yhat", *none)
    n = int(np.asarray(ends["n"]).sum())
    at = [(n - 1) * (1 - coverage), (n - 1) * coverage]
    near = written(every.withColumn("__c", _near(ends, k, n, at)("__p")), "near")
    chunks = max(1, -(-near.count() // CHUNK))
    near = near.withColumn("__salt", F.pmod(F.xxhash64(key, "y"), F.lit(chunks)))
    long = near.select(key, "y", "__p", "__salt", F.explode("__c").alias("__c"))
    # A cell is (side, how many lie below, and for each fold the first and the last range).
    folds = F.explode(F.array(*(F.struct(F.lit(f).alias("fold"), F.element_at("__c", 3 + 2 * f).alias("a"), F.element_at("__c", 4 + 2 * f).alias("b")) for f in range(k))))
    asked = long.select("__c", "__salt").distinct().select(F.col("__c").alias("__d"), F.col("__salt").alias("__t"), folds.alias("__f")).where("__f.a <= __f.b")
    asked = asked.select("__d", "__t", F.col("__f.fold").alias("fold"), F.explode(F.sequence("__f.a", "__f.b")).alias("range")).join(parts, ["fold", "range"])
    types = dict(every.dtypes)
    met = long.groupBy("__c", "__salt").cogroup(asked.groupBy("__d", "__t")).applyInArrow(_met(key, k, n, at), f"`{key}` {types[key]}, y {types['y']}, side int, bound double")
    # NULLs in keys and labels are values of a group like any other.
    sides = met.groupBy(key, "y").agg(*(F.max(F.when(F.col("side") == side, F.col("bound"))).alias(c) for side, c in enumerate(("low", "high"))))
    got = meet(near.where(F.size("__c") > 0).select(key, "y", "yhat"), sides, [key, "y"])
    return got.unionByName(near.where(F.size("__c") == 0).select(key, "y", "yhat", *none))


def _places(n: int, at: list[float]) -> list[tuple[int, int]]:
    """The places below and above the wanted ones by side. On the low side values are turned round, so there they count from the top."""
    return [(n - 1 - math.ceil(at[0]), n - 1 - math.floor(at[0])), (math.floor(at[1]), math.ceil(at[1]))]


def _slack(x: np.ndarray, height: np.ndarray) -> np.ndarray:
    """What adding a height and taking it off again may change: a range of one value must not miss itself."""
    return 4 * np.spacing(np.abs(x) + np.abs(height))


def _value_at(values: list[np.ndarray], before: list[np.ndarray], height: np.ndarray, place: int) -> np.ndarray:
    """For each row the value at a place in the order of all folds' values, each fold's raised by the row's ``height`` there.

    ``values`` are sorted and ``before[f][i]`` tells how many lie before the i-th: a binary search in each fold for its first value that
    has more than ``place`` up to it."""
    best = np.full(len(height), np.inf)
    for f, own in enumerate(values):
        low, high = np.zeros(len(height), int), np.full(len(height), len(own))
        while (open_ := low < high).any():
            middle = np.minimum((low + high) // 2, len(own) - 1)
            x, count = own[middle] + height[:, f], before[f][middle + 1]
            for g, other in enumerate(values):
                if g != f:
                    count = count + before[g][np.searchsorted(other, x - height[:, g] + _slack(x, height[:, g]), side="right")]
            high = np.where(open_ & (count > place), middle, high)
            low = np.where(open_ & (count <= place), middle + 1, low)
        if len(own):
            best = np.where(low < len(own), np.minimum(best, own[np.minimum(low, len(own) - 1)] + height[:, f]), best)
    return best


def _near(ends: pa.Table, k: int, n: int, at: list[float]):
    """A function over batches of test rows: from the fold predictions, the row's cell on both sides, low and high; none where a
    prediction is missing."""
    fold, low, high, count = (np.asarray(ends[c]) for c in ("fold", "low", "high", "n"))
    lows, highs = [low[fold == f] for f in range(k)], [high[fold == f] for f in range(k)]
    before = [np.concatenate([[0], np.cumsum(count[fold == f])]) for f in range(k)]
    places = _places(n, at)

    @F.pandas_udf("array<array<long>>")
    def near(predicted):
        import pandas as pd

        known = [i for i, p in enumerate(predicted) if p is not None and not any(x is None or x != x for x in p)]
        out: list[list] = [[] for _ in range(len(predicted))]
        if known:
            base = np.stack([np.asarray(predicted.iloc[i], float) for i in known])
            for side, (first, last) in enumerate(places):
                height = base if side else -base
                least, most = _value_at(lows, before, height, first), _value_at(highs, before, height, last)
                cell = [np.full(len(base), side), np.zeros(len(base), int)]
                for f in range(k):
                    a = np.searchsorted(highs[f], least - height[:, f] - 4 * _slack(least, height[:, f]), side="left")
                    cell[1] = cell[1] + before[f][a]
                    cell += [a, np.maximum(np.searchsorted(lows[f], most - height[:, f] + 4 * _slack(most, height[:, f]), side="right") - 1, a - 1)]
                for i, c in zip(known, np.stack(cell, axis=1).tolist()):
                    out[i].append(c)
        return pd.Series(out, dtype=object)

    return near


def _met(key: str, k: int, n: int, at: list[float]):
    """The bounds of test rows of one cell from the residuals of its ranges."""
    places = _places(n, at)

    def met(group: tuple, rows: pa.Table, residuals: pa.Table) -> pa.Table:
        side, below = (int(x) for x in group[0].as_py()[:2])
        fold, order = np.asarray(residuals["fold"]), np.asarray(residuals["range"])
        r, count = residuals["r"].to_pylist(), residuals["n"].to_pylist()
        values, before = [], []
        for f in range(k):
            mine = np.flatnonzero(fold == f)
            mine = mine[np.argsort(order[mine])]
            values.append(np.concatenate([np.zeros(0), *(r[i] for i in mine)]))
            before.append(np.cumsum(np.concatenate([[0], *(count[i] for i in mine)]).astype(np.int64)))
        base = np.asarray(rows["__p"].combine_chunks().flatten(), float).reshape(-1, k)
        first, last = (_value_at(values, before, base if side else -base, place - below) for place in places[side])
        part = at[side] - math.floor(at[side])
        bound = first + part * (last - first) if side else -last + part * (last - first)
        return pa.table({key: rows[key], "y": rows["y"], "side": pa.array(np.full(len(base), side, np.int32)), "bound": pa.array(bound)})

    return met


def quantile_tree(train: DataFrame, features: list[str], label: str, quantiles: list[float], depth: int = 4, least: int = 20):
    """A regression tree whose leaves hold label quantiles (MLlib has no quantile loss). Returns a function that adds q0, q1, ... to rows."""
    rows = assemble(train, features)
    model = DecisionTreeRegressor(featuresCol=VECTOR, labelCol=label, predictionCol="__y", leafCol="__leaf", maxDepth=depth, minInstancesPerNode=least, seed=1).fit(rows)
    leaves = quantiles_of(model.transform(rows).select("__leaf", label), label, quantiles, ["__leaf"])  # 2 ** depth rows at most

    def predict(df: DataFrame) -> DataFrame:
        got = model.transform(assemble(df, features)).join(F.broadcast(leaves), "__leaf", "left")
        return got.withColumns({f"q{i}": F.col("__q")[i] for i in range(len(quantiles))}).drop("__q", "__leaf", "__y", VECTOR)

    return predict


def conformalized_quantiles(train: DataFrame, calibration: DataFrame, test: DataFrame, features: list[str], label: str, coverage: float = 0.9, **boosting) -> DataFrame:
    """Quantile bounds, widened by the calibration set's quantile of how far labels lie outside.

    The lower, the middle and the upper bound are models boosted with pinball loss; ``boosting`` goes to ``quantile_boosting``."""
    a = (1 - coverage) / 2
    models = quantile_boosting(train, features, label, [a, 0.5, 1 - a], **boosting)

    def predict(df: DataFrame) -> DataFrame:
        return df.na.drop(subset=features).withColumns({f"__q{k}": m.column() for k, m in enumerate(models)})

    out = written(predict(calibration).select(F.greatest(F.col("__q0") - F.col(label), F.col(label) - F.col("__q2")).alias("s")), "scores")
    q = conformal_quantile(out.where("s is not null"), F.col("s"), coverage, name="__q", signed=True).select("__q")
    got = predict(test).join(F.broadcast(q))  # one row
    return got.select(*test.columns, F.col("__q1").alias("yhat"), (F.col("__q0") - F.col("__q")).alias("low"), (F.col("__q2") + F.col("__q")).alias("high"))
