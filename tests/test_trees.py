"""Trees from aggregates, boosting and Shapley values, against brute force and closed forms."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from measura.operators import boosting, conformal, shapley, trees
from measura.operators.models import Spec

X = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)).round(2)
    y = 20 + 6 * x[:, 0] - 3 * x[:, 1] + 2 * x[:, 0] * (x[:, 2] > 0) + rng.normal(size=400)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i]), i % 4) for i in range(400)], "id long, a double, b double, c double, d double, y double, part int")
    return df.cache()


def table(df):
    got = df.orderBy("id").collect()
    return np.array([[r[c] for c in X] for r in got]), np.array([r.y for r in got])


def plain_best(x, y, options):
    """The split with the least squared error left, in plain numpy."""
    def left(f, c):
        m = x[:, f] <= c
        return sum(((y[s] - y[s].mean()) ** 2).sum() for s in (m, ~m)) if m.any() and (~m).any() else np.inf

    return min(options, key=lambda o: (left(*o), o))


def test_one_level_has_the_best_quantile_threshold(rows):
    x, y = table(rows)
    tree = trees.grow(trees.usable(rows, X, "y"), X, depth=1, bins=8)[0]
    options = [(f, c) for f in range(4) for c in set(np.quantile(x[:, f], np.arange(1, 8) / 8))]
    want = plain_best(x, y, options)
    assert tree.feature[0] == want[0] and np.isclose(tree.threshold[0], want[1])
    m = x[:, want[0]] <= want[1]
    assert np.allclose(tree.value, [y.mean(), y[m].mean(), y[~m].mean()]) and np.allclose(tree.cover, [400, m.sum(), (~m).sum()])


def test_one_level_with_random_thresholds(rows):
    x, y = table(rows)
    for t, tree in enumerate(trees.grow(trees.usable(rows, X, "y"), X, trees=3, depth=1, random=True, seed=9)):
        options = [(f, x[:, f].min() + trees.draw(9, t, 1, c) * np.ptp(x[:, f])) for f, c in enumerate(X)]
        want = plain_best(x, y, options)
        assert tree.feature[0] == want[0] and np.isclose(tree.threshold[0], want[1])


def test_trees_grow_alike_however_rows_are_dealt(rows):
    one = trees.random_trees(rows.coalesce(1), X, "y", 4, 4, seed=5)
    many = trees.random_trees(rows.repartition(7), X, "y", 4, 4, seed=5)
    for a, b in zip(one.trees, many.trees):
        assert a.feature == b.feature and np.allclose(a.threshold, b.threshold) and np.allclose(a.value, b.value)
    assert len({tuple(t.threshold) for t in one.trees}) == 4  # each tree has thresholds of its own
    assert np.isclose(sum(one.importance().values()), 1) and max(one.importance(), key=one.importance().get) == "a"


def test_random_trees_as_a_model(rows):
    fitted = Spec("random_trees", {"trees": 20, "depth": 6, "subset": 4}).fit(rows, X, "y")
    got = fitted.predict(rows).agg(F.corr("y", "yhat")).first()[0]
    assert got > 0.95
    gaps = rows.withColumn("a", F.when(F.col("id") > 9, F.col("a")))
    assert fitted.predict(gaps).count() == 390


def test_empty_and_constant_tables(spark, rows):
    assert trees.grow(trees.usable(rows.limit(0), X, "y"), X)[0].feature == [-1]
    flat = trees.grow(trees.usable(rows.withColumn("y", F.lit(2.0)), X, "y"), X)[0]
    assert flat.feature == [-1] and flat.value == [2.0]
    assert trees.grow(trees.usable(rows.withColumns({c: F.lit(1.0) for c in X}), X, "y"), X, random=True)[0].feature == [-1]


def brute_shapley(model, x):
    """Shapley values by all subsets; an unknown feature goes down both sides by cover."""
    def value(tree, known, at=0):
        f = tree.feature[at]
        if f < 0:
            return tree.value[at]
        if f in known:
            return value(tree, known, tree.left[at] if x[f] <= tree.threshold[at] else tree.right[at])
        return sum(tree.cover[k] / tree.cover[at] * value(tree, known, k) for k in (tree.left[at], tree.right[at]))

    def game(known):
        return model.offset + sum(w * value(t, known) for t, w in zip(model.trees, model.weights))

    n = len(x)
    out = []
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        out.append(sum(math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (game({*s, i}) - game(set(s)))
                       for k in range(n) for s in itertools.combinations(rest, k)))
    return out


@pytest.mark.parametrize("spec", [Spec("tree", {"maxDepth": 4}), Spec("forest", {"numTrees": 4, "maxDepth": 4}), Spec("boosting", {"maxIter": 3}), Spec("random_trees", {"trees": 3, "depth": 5})])
def test_shapley_values(rows, spec):
    fitted = spec.fit(rows, X, "y")
    model = shapley.model_trees(fitted.model, X, rows)
    got = shapley.shapley_values(model, fitted.predict(rows, "own")).collect()
    assert len(got) == 400 and np.isclose(np.mean([r.yhat for r in got]), got[0]["mean"])
    for r in got:
        assert abs(r.own - r.yhat) < 1e-9 and abs(sum(r.shapley) + r["mean"] - r.yhat) < 1e-9
    for r in got[:12]:
        assert np.allclose(r.shapley, brute_shapley(model, [r[c] for c in X]), atol=1e-9)
    ranking = shapley.shapley_ranking(model, rows).orderBy("place").collect()
    assert [r.feature for r in ranking][:2] == ["a", "b"] and np.isclose(ranking[0].importance, np.mean([abs(r.shapley[0]) for r in got]))


def test_permutation_importance(rows):
    fitted = Spec("ridge", {"alpha": 1e-6}).fit(rows, X, "y")
    got = {r.feature: r for r in shapley.permutation_importance(fitted, rows, "id", "y").collect()}
    assert got["a"].place == 1 and got["a"].importance > got["b"].importance > got["d"].importance and abs(got["d"].importance) < 0.05
    # A shuffled column is still the same column.
    x, y = table(rows)
    w, v = fitted.model.coefficients.toArray(), np.var(y)
    for k, c in enumerate(X):
        want = (2 * w[k] * np.cov(x[:, k], y, bias=True)[0, 1]) / v  # the expected loss of r2, other terms being centred
        assert abs(got[c].importance - want) < 0.25


def test_signs_are_kept(rows):
    signs = {"a": 1, "b": -1, "c": -1}  # c helps for real: the sign must win
    free = boosting.boosted_trees(rows, X, "y", 12, 0.3, 4)
    held = boosting.boosted_trees(rows, X, "y", 12, 0.3, 4, signs=signs)
    base = np.random.default_rng(1).normal(size=(60, 4))
    turned = 0
    for c, sign in signs.items():
        k = X.index(c)
        grid = np.repeat(base, 41, axis=0)
        grid[:, k] = np.tile(np.linspace(-3, 3, 41), 60)
        steps = [sign * np.diff(m.values(grid).reshape(60, 41), axis=1) for m in (held, free)]
        assert (steps[0] >= -1e-12).all()
        turned += (steps[1] < -1e-9).any()
    assert turned  # the free model does turn
    same = boosting.boosted_trees(rows, X, "y", 12, 0.3, 4, signs={"d": 0})
    assert all(a.feature == b.feature and np.allclose(a.value, b.value) for a, b in zip(free.trees, same.trees))
    x, y = table(rows)
    assert np.corrcoef(held.values(x), y)[0, 1] > 0.9


def loss(y, p, q):
    return np.maximum(q * (y - p), (q - 1) * (y - p)).mean()


def test_a_stump_of_pinball_boosting(rows):
    x, y = table(rows)
    q = 0.8
    model = boosting.quantile_boosting(rows, ["a"], "y", [q], stages=1, rate=1.0, depth=1, bins=8)[0]
    start = np.quantile(y, q)
    g = np.where(y > start, q, q - 1)
    _, cut = plain_best(x[:, :1], g, [(0, c) for c in set(np.quantile(x[:, 0], np.arange(1, 8) / 8))])
    m = x[:, 0] <= cut
    want = start + np.where(m, np.quantile(y[m] - start, q), np.quantile(y[~m] - start, q))
    assert np.allclose(model.values(x[:, :1]), want)


def test_pinball_boosting_beats_one_quantile_tree(rows):
    train, test = rows.where("part < 3"), rows.where("part = 3")
    levels = [0.1, 0.5, 0.9]
    models = boosting.quantile_boosting(train, X, "y", levels, stages=12, rate=0.5, depth=3)
    one = conformal.quantile_tree(train, X, "y", levels)(test).orderBy("id").collect()
    x, y = table(test)
    for k, (q, m) in enumerate(zip(levels, models)):
        assert loss(y, m.values(x), q) < loss(y, np.array([r[f"q{k}"] for r in one]), q)
    below = [(y <= m.values(x)).mean() for m in models]
    assert below[0] < 0.3 and 0.3 < below[1] < 0.7 and below[2] > 0.7


def test_conformal_quantile_boosting_covers(rows):
    got = conformal.conformalized_quantiles(rows.where("part < 2"), rows.where("part = 2"), rows.where("part = 3"), X, "y", 0.9, stages=4)
    assert got.count() == 100 and got.agg(F.avg(F.col("y").between(F.col("low"), F.col("high")).cast("int"))).first()[0] >= 0.8


@pytest.mark.parametrize("few,parts", [(2_000, 512), (1, 2), (5, 3), (40, 8)])
def test_group_quantiles(rows, few, parts):
    x, y = table(rows)
    usable = trees.usable(rows, X, "y")
    level = [0.0, 0.1, 0.5, 0.9, 1.0]

    def values(x, y):
        return [(np.where(x[:, 0] > 0, 0, 1), y), (2 + (x[:, 1] > 0.5), np.round(x[:, 2])), (np.full(len(y), 4), np.full(len(y), 7.0))]

    got = trees.group_quantiles(usable, 4, values, lambda g: level[g], few, parts)
    for g in range(5):
        v = np.concatenate([v[k == g] for k, v in values(x, y)])
        assert np.isclose(got[g], np.quantile(v, level[g])), g
