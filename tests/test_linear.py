"""Linear models from sums against closed forms, optimality conditions and plain fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from measura.operators import evaluate, linear, metrics
from measura.operators.models import Spec

X = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) * [1, 5, 0.2, 1] + [0, 1e4, 3, 0]
    x[:, 3] += x[:, 0]
    y = 1e3 + 4 * x[:, 0] - 2 * x[:, 1] + 5 * x[:, 2] + rng.normal(size=300)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i]), i % 3, i // 3 % 2, 1.0 + i % 5) for i in range(300)],
                               "id long, a double, b double, c double, d double, y double, fold int, inner int, w double")
    return df.repartition(5).cache()


def table(df):
    got = df.orderBy("id").collect()
    return np.array([[r[c] for c in X] for r in got]), np.array([r.y for r in got]), np.array([r.w for r in got])


def test_sums(rows):
    x, y, w = table(rows)
    got = linear.sums(rows, X, "y", ["fold"], "w")
    assert sorted(got) == [(0,), (1,), (2,)]
    every = linear.total(list(got.values()))
    mean, second = every.centred()
    z = np.c_[x, y]
    assert np.allclose(mean, np.average(z, axis=0, weights=w)) and every.rows == 300
    assert np.allclose(second, ((z - mean).T * w) @ (z - mean), rtol=1e-8)
    m = linear.Linear(np.array([1.0, 2.0, 3.0, 4.0]), 5.0)
    assert np.isclose(every.squared_error(m.weights, 5.0), (w * (y - x @ m.weights - 5) ** 2).sum())
    assert linear.sums(rows.limit(0), X, "y", ["fold"]) == {}


def test_ridge_with_weights(rows):
    x, y, w = table(rows)
    got = Spec("ridge", {"alpha": 3.0}, "w").fit(rows, X, "y").model
    c, d = x - np.average(x, axis=0, weights=w), y - np.average(y, weights=w)
    want = np.linalg.solve((c.T * w) @ c + 3 * np.eye(4), (c.T * w) @ d)
    assert np.allclose(got.weights, want, rtol=1e-7)


def test_elastic_net_of_one_feature_has_the_closed_form(rows):
    x, y, _ = table(rows)
    v, c = np.var(x[:, 1]), np.cov(x[:, 1], y, bias=True)[0, 1]
    for alpha, mix in ((1.0, 0.5), (3.0, 1.0), (2.0, 0.0), (1e4, 0.5)):
        want = np.sign(c) * max(abs(c) - alpha * mix, 0) / (v + alpha * (1 - mix))
        assert np.isclose(Spec("elastic", {"alpha": alpha, "mix": mix}).fit(rows, ["b"], "y").model.weights[0], want)
        tiny = Spec("elastic", {"alpha": alpha * 300, "mix": mix, "per_row": True}).fit(rows, ["b"], "y").model.weights[0]
        assert np.isclose(tiny, want)


@pytest.mark.parametrize("kind,alpha,mix", [("elastic", 0.3, 0.5), ("lasso", 0.2, 1.0), ("elastic", 0.01, 0.1)])
def test_elastic_net_is_optimal(rows, kind, alpha, mix):
    x, y, _ = table(rows)
    got = Spec(kind, {"alpha": alpha, "mix": mix}).fit(rows, X, "y").model
    slope = (x - x.mean(axis=0)).T @ (y - x @ got.weights - got.intercept) / len(y) - alpha * (1 - mix) * got.weights
    for s, w in zip(slope, got.weights):
        assert abs(s - alpha * mix * np.sign(w)) < 1e-6 if w else abs(s) <= alpha * mix + 1e-6
    assert np.isclose((y - x @ got.weights - got.intercept).mean(), 0, atol=1e-7)


def test_a_path_of_penalties(rows):
    s = linear.sums(rows, X, "y")[()]
    alphas = [0.01, 100.0, 1.0]
    for a, m in zip(alphas, linear.path(s, alphas, 0.7)):
        assert np.allclose(m.weights, linear.solve(s, "elastic", a, 0.7).weights, atol=1e-6)
    assert [(m.weights != 0).sum() for m in linear.path(s, [100.0, 0.01], 1.0)] == sorted((m.weights != 0).sum() for m in linear.path(s, [100.0, 0.01], 1.0))


def test_repeated_columns_have_a_solution(rows):
    got = Spec("ridge", {"alpha": 0.0}).fit(rows.withColumn("e", F.col("a")).withColumn("one", F.lit(1.0)), ["a", "e", "one"], "y").model
    assert np.isfinite(got.weights).all() and np.isclose(got.weights[0], got.weights[1])


@pytest.mark.parametrize("spec", [Spec("ridge", {"alpha": 2.0}), Spec("lasso", {"alpha": 0.1}), Spec("elastic", {"alpha": 0.1, "mix": 0.3}, "w")])
def test_validation_equals_a_fit_for_each_fold(rows, spec):
    gaps = rows.withColumn("c", F.when(F.col("id") % 50 > 0, F.col("c")))
    got = {r.id: (r.fold, r.yhat) for r in evaluate.cross_validate(gaps, spec, X, "y", 3, "id").collect()}
    assert len(got) == 294
    for f in range(3):
        fitted = spec.fit(gaps.where(F.col("fold") != f), X, "y")
        for r in fitted.predict(gaps.where(F.col("fold") == f)).collect():
            assert got[r.id][0] == f and abs(got[r.id][1] - r.yhat) < 1e-6


def test_nested_validation_equals_fits(rows):
    grid = {"alpha": [0.01, 30.0, 1e5]}
    got, chosen = evaluate.nested_cv(rows, "ridge", grid, X, "y", "id", 3, tries=3)
    for f in range(3):
        train = rows.where(F.col("fold") != f)
        scores = {}
        for alpha in grid["alpha"]:
            parts = evaluate.cross_validate(train, Spec("ridge", {"alpha": alpha}), X, "y", 2, "id", "inner")
            scores[alpha] = metrics.regression_metrics(parts, "y", "yhat").first().r2
        assert chosen[f]["alpha"] == max(scores, key=scores.get)
        want = {r.id: r.yhat for r in Spec("ridge", chosen[f]).fit(train, X, "y").predict(rows.where(F.col("fold") == f)).collect()}
        own = {r.id: r.yhat for r in got.where(F.col("fold") == f).collect()}
        assert own.keys() == want.keys() and all(abs(own[i] - want[i]) < 1e-6 for i in want)


def test_one_scan_for_all_folds(spark, rows):
    """The sums of all folds are one aggregate: one exchange, whatever the number of folds."""
    seen = []
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sums", "sums")
    linear.sums(rows, X, "y", ["fold", "inner"])
    seen = tracker.getJobIdsForGroup("sums")
    spark.sparkContext.setJobGroup("", "")
    assert 1 <= len(seen) <= 4
