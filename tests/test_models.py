"""Invariants of fitted models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from measura.operators import linear, conformal, evaluate, models, prep, select
from measura.operators.models import Spec

X = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 3))
    y = 300 + 10 * x[:, 0] + 3 * x[:, 1] + rng.normal(size=240)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i]), i % 3, (i // 3) % 2) for i in range(240)], "id long, x1 double, x2 double, x3 double, y double, fold int, inner int")
    return df.cache()


def test_ridge_has_the_closed_form(rows):
    a = np.array([[r.x1, r.x2, r.x3] for r in rows.orderBy("id").collect()])
    y = np.array([r.y for r in rows.orderBy("id").collect()])
    alpha = 7.0
    c, d = a - a.mean(axis=0), y - y.mean()
    want = np.linalg.solve(c.T @ c + alpha * np.eye(3), c.T @ d)
    assert np.allclose(Spec("ridge", {"alpha": alpha}).fit(rows, X, "y").model.coefficients.toArray(), want, atol=1e-5)


def test_every_row_is_tested_once(rows):
    got = evaluate.cross_validate(rows, Spec("ridge"), X, "y", 3, "id")
    assert got.count() == 240 and got.select("id").distinct().count() == 240
    nested, chosen = evaluate.nested_cv(rows, "ridge", {"alpha": [0.1, 1.0]}, X, "y", "id", 3, tries=5)
    assert nested.count() == 240 and len(chosen) == 3


def test_contributions_sum_to_the_prediction(rows):
    got = models.hierarchical(rows.where("fold <> 0"), rows.where("fold = 0"), [["x1"], ["x2"], []], "y", Spec("boosting", {"maxIter": 2}))
    assert got.where(F.abs(F.col("part0") + F.col("part1") + F.col("part2") + F.col("part3") - F.col("yhat")) > 1e-6).count() == 0


def test_two_stage_is_the_mean_of_trees(rows):
    got = models.two_stage(rows.where("fold = 1"), rows.where("fold = 2"), rows.where("fold = 0"), X, "y", 2, 6)
    assert got.where(F.abs((2 * F.col("a") + 4 * F.col("b")) / 6 - F.col("yhat")) > 1e-9).count() == 0


def test_intervals_cover(rows):
    parts = rows.where("fold = 0"), rows.where("fold = 1"), rows.where("fold = 2")
    for got in (conformal.split_conformal(*parts, Spec("ridge"), X, "y"), conformal.conformalized_quantiles(*parts, X, "y"),
                conformal.cross_conformal(rows.where("fold <> 2"), parts[2], Spec("ridge"), X, "y", "id", 2)):
        assert got.agg(F.avg(F.col("y").between(F.col("low"), F.col("high")).cast("int"))).first()[0] >= 0.8


def test_cross_conformal_uses_all_residuals(rows):
    train, test = rows.where("fold <> 2").withColumn("fold", F.when(F.col("id") % 4 == 0, 0).otherwise(1)), rows.where("fold = 2")
    values, heights = [], {}
    for f in range(2):
        fitted = Spec("ridge").fit(train.where(F.col("fold") != f), X, "y")
        r = np.array([abs(x.y - x.yhat) for x in fitted.predict(train.where(F.col("fold") == f)).collect()])
        values.append(r)
        for x in fitted.predict(test).collect():
            heights.setdefault(x.id, []).append(x.yhat)
    assert len(values[0]) != len(values[1])
    got = conformal.cross_conformal(train, test, Spec("ridge"), X, "y", "id", 2, levels=10).collect()
    assert len(got) == test.count()
    for x in got:
        low, high = (np.concatenate([h + s * r for h, r in zip(heights[x.id], values)]) for s in (-1, 1))
        assert np.allclose((x.yhat, x.low, x.high), (np.mean(heights[x.id]), np.quantile(low, 0.1), np.quantile(high, 0.9)), atol=1e-9)


def test_selection(rows):
    assert select.mrmr(rows, X, "y", 2)[0] == "x1"
    assert select.importance_ranking(rows, X, "y", 1)[0][0] == "x1"
    kept, log = select.selection_pipeline(rows.withColumn("flat", F.lit(1.0)), "id", [*X, "flat"], "y", 1, many=2)
    assert kept == ["x1"] and log[0] == ("variance", 4, 3) and [s for s, _, _ in log] in (["variance", "boruta", "importance"], ["variance", "boruta", "mrmr", "importance"])
    got = select.selected_rows(rows, "id", ["x3", "x1"]).where("id = 7").orderBy("place").collect()
    assert [r.feature for r in got] == ["x3", "x1"] and got[1].value == rows.where("id = 7").first().x1


def test_boruta_rejects_noise_that_correlates(spark):
    """Two noisy columns that go together: shadows of whole rows keep their bond, shadows of their own order do not."""
    rng = np.random.default_rng(6)
    n = 300
    noise = rng.normal(size=n)
    x = np.c_[rng.normal(size=n), rng.normal(size=n), noise, noise + rng.normal(size=n) * 0.1]
    y = 5 * x[:, 0] - 4 * x[:, 1] + rng.normal(size=n)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(n)], "id long, a double, b double, u double, v double, y double").repartition(2).cache()
    features = ["a", "b", "u", "v"]
    mixed = select.with_shadows(df, "id", features, 1).orderBy("id").collect()
    assert len(mixed) == n
    for k, c in enumerate(features):
        shadow = np.array([r[f"shadow_{c}"] for r in mixed])
        assert np.allclose(np.sort(shadow), np.sort(x[:, k])) and abs(np.corrcoef(shadow, x[:, k])[0, 1]) < 0.2
    apart = np.array([(r.shadow_u, r.shadow_v) for r in mixed])
    assert abs(np.corrcoef(apart.T)[0, 1]) < 0.2 < 0.9 < np.corrcoef(x[:, 2], x[:, 3])[0, 1]
    found = select.boruta(df, "id", features, "y", rounds=12, trees=10)
    assert found.decision["a"] == found.decision["b"] == "confirmed" and {found.decision["u"], found.decision["v"]} <= {"rejected", "weak"}
    assert found.kept == ["a", "b"] and min(found.rounds.values()) <= 12 and found.hits["a"] == found.rounds["a"] and found.hits["u"] < 6


def test_corrections_for_many_tests():
    assert select.binomial_tail(0, 7) == 1 and select.binomial_tail(7, 7) == 2 ** -7
    assert select.discoveries([0.01, 0.04, 0.03, 0.5], 0.05) == [True, False, False, False]
    assert select.discoveries([0.01, 0.02, 0.03, 0.5], 0.05) == [True, True, True, False]


def test_neighbour_information_against_brute_force(spark):
    rng = np.random.default_rng(9)
    n, k = 500, 3
    x = np.c_[rng.normal(size=n), np.round(rng.normal(size=n), 1), rng.normal(size=n)]
    y = np.sin(2 * x[:, 0]) + 0.3 * x[:, 1] + 0.1 * rng.normal(size=n)
    df = spark.createDataFrame([(*map(float, x[i]), float(y[i])) for i in range(n)], "a double, b double, c double, y double").repartition(3)
    got = {r.feature: r.information for r in select.neighbour_information(df, ["a", "b", "c"], "y", k).collect()}

    def psi(m):
        z = m + 8.0
        return np.log(z) - 1 / (2 * z) - 1 / (12 * z ** 2) + 1 / (120 * z ** 4) - 1 / (252 * z ** 6) - sum(1 / (m + j) for j in range(8))

    b = y / y.std()
    for j, c in enumerate("abc"):
        a = x[:, j] / x[:, j].std()
        da, db = np.abs(a[:, None] - a), np.abs(b[:, None] - b)
        reach = np.sort(np.maximum(da, db), axis=1)[:, k] * (1 - 1e-10)
        want = psi(n) + psi(k) - np.mean(psi((da <= reach[:, None]).sum(axis=1))) - np.mean(psi((db <= reach[:, None]).sum(axis=1)))
        assert abs(got[c] - max(want, 0)) < 1e-6
    assert got["a"] > got["b"] > got["c"]
    assert [c for c, _, _ in select.mrmr_steps(df, ["a", "b", "c"], "y", 2)] == ["a", "b"]
    binned = {r.feature: r.information for r in select.binned_information(df, ["a", "b", "c"], "y").collect()}
    assert binned["a"] > binned["b"] and binned["a"] > binned["c"]


def test_preparation(spark, rows):
    s = prep.Scaler.fit(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (5.0, 5.0)], "a double, b double"), ["a", "b"])
    assert np.isclose(s.std["a"], np.sqrt(8 / 3)) and s.std["b"] == 1e-10
    assert prep.medians(spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double"), ["a", "b"]) == {"a": 1.5, "b": 0.0}
    skewed = rows.withColumn("e", F.exp("x1"))
    p = prep.PowerScaler.fit(skewed, ["e"])
    assert p.power["e"] < 0.3
    ends = p.transform(skewed).agg(F.min("e"), F.max("e")).first()
    assert np.allclose(ends, (0, 1))
    pca = prep.Components.fit(rows, X, 9)
    assert len(pca.explained) == 3 and np.isclose(sum(pca.explained), 1)
    assert pca.transform(rows.withColumn("x1", F.when(F.col("id") > 0, F.col("x1")))).where("pc0 is null").count() == 1


def test_stacking_and_scan(rows):
    oof, meta = models.stack(rows, {"r": (Spec("ridge"), X), "t": (Spec("tree"), X)}, "y", 3)
    assert oof.count() == 240 and meta.features == ["oof_r", "oof_t"]
    best = evaluate.compare(rows, [("one", Spec("ridge"), ["x3"]), ("all", Spec("ridge"), X)], "y", 3, "id").orderBy("rank").first()
    assert best.model == "all" and best.delta > 0


def test_repeated_folds_test_every_row_once_a_repeat(rows):
    got = evaluate.repeated(rows, "id", 3, 2, lambda df: evaluate.cross_validate(df, Spec("ridge"), X, "y", 3, "id"))
    assert got.count() == 480 and {x["count"] for x in got.groupBy("id").count().collect()} == {2}
    assert {x.fold: x["count"] for x in got.groupBy("fold").count().collect()} == dict.fromkeys(range(6), 80)
    first, second = ({frozenset(x.i) for x in got.where(f"fold div 3 = {r}").groupBy("fold").agg(F.collect_list("id").alias("i")).collect()} for r in (0, 1))
    assert not first & second  # another order for each repeat
    nested = evaluate.repeated(rows, "id", 2, 2, lambda df: evaluate.nested_cv(df, "ridge", {"alpha": [0.1, 1.0]}, X, "y", "id", 2)[0])
    assert nested.count() == 480 and nested.select("fold").distinct().count() == 4


def test_validation_of_the_hierarchy_is_that_of_its_folds(rows):
    groups, last = [["x1"], ["x2"], ["x3"]], Spec("boosting", {"maxIter": 2})
    got = {x.id: x.yhat for x in evaluate.hierarchical_cv(rows, groups, "y", 3, "id", last).collect()}
    assert len(got) == 240
    for x in models.hierarchical(rows.where("fold <> 1"), rows.where("fold = 1"), groups, "y", last).collect():
        assert abs(got[x.id] - x.yhat) < 1e-9


def test_weights_with_a_scaler_of_all_training_rows(rows):
    gold, other = rows.where("id % 2 = 0"), rows.where("id % 2 = 1").withColumns({"x1": F.col("x1") * 3 + 9, "y": F.col("y") + 60})
    got = {x.id: x.yhat for x in evaluate.weighted_cv(gold, [(other, 0.3)], Spec("ridge", {"alpha": 0.0}), X, "y", 3, "id").collect()}
    assert len(got) == 120
    train, test = gold.where("fold <> 0").select(*X, "y").unionByName(other.select(*X, "y")), gold.where("fold = 0")
    scaler = prep.PowerScaler.fit(train, X)
    w = np.r_[np.ones(gold.where("fold <> 0").count()), np.full(other.count(), 0.3)]
    parts = [scaler.transform(df).select(*X, "y").collect() for df in (gold.where("fold <> 0"), other)]
    a = np.array([[x.x1, x.x2, x.x3, 1] for p in parts for x in p])
    y = np.array([x.y for p in parts for x in p])
    want = np.linalg.solve(a.T * w @ a, a.T * w @ y)
    for x in scaler.transform(test).collect():
        assert abs(got[x.id] - np.array([x.x1, x.x2, x.x3, 1]) @ want) < 1e-4


def test_the_best_weight(rows):
    gold, other = rows.where("id % 2 = 0"), rows.where("id % 2 = 1").withColumn("y", F.col("y") + 60)
    got = evaluate.weight_scan(gold, {"o": other}, [0.0, 0.5, 1.0], X, "y", 3, "id").collect()
    assert [x.model for x in got if x.best] == [max(got, key=lambda x: x.r2_mean).model] == ["w=0.0"]
    flat = evaluate.weight_scan(gold.withColumn("y", F.rand(3)), {"o": other}, [0.5], X, "y", 3, "id").collect()
    assert flat[0].r2_mean < 0 and not flat[0].best


def test_committee_learns_from_training_rows_alone(rows):
    experts = {"a": (Spec("ridge"), ["x1"]), "b": (Spec("ridge"), ["p0", "p1", "p2"])}
    shape = {"p": (["x2", "x3"], 3)}  # two columns give two components
    got = evaluate.committee_cv(rows, experts, "y", 3, "id", ["x2"], shape, meta=Spec("ridge", {"alpha": 1e-6}))
    assert got.count() == 240 and regression(got) > 0.9
    # Test rows' labels must not matter, nor must the features of other test rows.
    other = rows.withColumns({"y": F.when(F.col("fold") == 0, F.col("y") * 7).otherwise(F.col("y")), "x3": F.when((F.col("fold") == 0) & (F.col("id") > 9), F.col("x3") * 50).otherwise(F.col("x3"))})
    both = [{x.id: x.yhat for x in evaluate.committee_cv(df, experts, "y", 1, "id", ["x2"], shape, meta=Spec("ridge", {"alpha": 1e-6})).where("id < 10").collect()} for df in (rows, other)]
    assert both[0] and both[0].keys() == both[1].keys() and all(abs(both[0][i] - both[1][i]) < 1e-9 for i in both[0])
    gaps = rows.withColumn("x2", F.when(F.col("id") % 5 > 0, F.col("x2")))
    assert evaluate.committee_cv(gaps, experts, "y", 3, "id", ["x2"], shape).count() == 240


def regression(got):
    from measura.operators.metrics import regression_metrics

    return regression_metrics(got, "y", "yhat").first().r2


def test_leak_free_models(spark):
    gold = spark.createDataFrame([(i, float(i), 3.0 * i, i % 3) for i in range(30)], "k long, x double, y double, fold int")
    # Virtual rows of parent 0 are far off: they may not touch the fold that tests it.
    virtual = spark.createDataFrame([(a, b, float(a + b) / 2, 1e6 if a == 0 else 1.5 * (a + b)) for a in range(30) for b in range(a + 1, 30)], "k1 long, k2 long, x double, y double")
    got = evaluate.leak_free_cv(gold, virtual, Spec("ridge", {"alpha": 0.0}), ["x"], "y", 3, "k", weight=0.1, trees=(2, 5), scale=True)
    assert {x.model: x["count"] for x in got.groupBy("model").count().collect()} == dict.fromkeys(("baseline", "virtual", "weighted", "two_stage"), 30)
    worst = {(x.model, x.fold): x.e for x in got.groupBy("model", "fold").agg(F.max(F.abs(F.col("y") - F.col("yhat"))).alias("e")).collect()}
    assert all(worst[m, 0] < 30 for m in ("baseline", "virtual", "weighted", "two_stage")) and worst["virtual", 1] > 1000 and worst["weighted", 1] > 100


def test_leak_free_validation_reads_virtual_rows_once(spark, monkeypatch):
    """each model of each fold made all virtual rows anew; now the sums by the parents' folds give all of them."""
    gold = spark.createDataFrame([(k, float(k), 2.0 * k + k % 7, k % 3 if k != 4 else None) for k in range(24)], "k long, x double, y double, fold int")
    g = {r.k: r for r in gold.collect()}
    made = [(a, b, (g[a].x + g[b].x) / 2, (g[a].y * g[b].y) ** 0.5) for a in g for b in g if a < b]
    virtual = spark.createDataFrame(made, "k1 long, k2 long, x double, y double")
    calls, sums = [], evaluate.linear.sums
    monkeypatch.setattr(evaluate.linear, "sums", lambda *a, **b: calls.append(1) or sums(*a, **b))
    got = evaluate.leak_free_cv(gold, virtual, Spec("ridge", {"alpha": 1.0}), ["x"], "y", 3, "k", weight=0.1)
    assert len(calls) == 1
    carried = virtual.join(gold.select(F.col("k").alias("k1"), F.col("fold").alias("fold1")), "k1").join(gold.select(F.col("k").alias("k2"), F.col("fold").alias("fold2")), "k2")
    same = evaluate.leak_free_cv(gold, carried, Spec("ridge", {"alpha": 1.0}), ["x"], "y", 3, "k", weight=0.1)
    at = {(r.model, r.k): r.yhat for r in same.collect()}
    for r in got.collect():
        rows = [(q.x, q.y, 1.0) for q in g.values() if q.fold is not None and q.fold != r.fold]
        if r.model != "baseline":
            rows += [(x, y, 0.1 if r.model == "weighted" else 1.0) for a, b, x, y in made if r.fold not in (g[a].fold, g[b].fold)]
        x, y, w = np.array(rows).T
        mx, my = np.average(x, weights=w), np.average(y, weights=w)
        slope = (w * (x - mx) * (y - my)).sum() / ((w * (x - mx) ** 2).sum() + 1.0)
        assert np.isclose(r.yhat, my + slope * (g[r.k].x - mx)) and np.isclose(r.yhat, at[r.model, r.k])
    assert len(at) == 3 * 23


def test_sums_of_few_and_many_columns_agree(spark, rows, monkeypatch):
    few = linear.sums(rows, X, "y", weight="x1")
    monkeypatch.setattr(linear, "FEW_COLUMNS", 0)
    many = linear.sums(rows, X, "y", weight="x1")
    assert few.keys() == many.keys() == {()} and np.allclose(few[()].second, many[()].second) and np.allclose(few[()].first, many[()].first) and few[()].rows == many[()].rows
    monkeypatch.undo()
    assert linear.sums(rows.where("y is null"), X, "y") == {}


def test_reaches_in_a_plane_against_brute_force(spark, monkeypatch):
    """Points in small tiles, with steps, copies, far ones and too few rows; a point is compared with few others."""
    from measura.operators import plane

    monkeypatch.setattr(plane, "OF_TILE", 16)
    monkeypatch.setattr(plane, "SAMPLED", 4)
    rng = np.random.default_rng(3)
    x = np.r_[rng.integers(0, 5, 300), np.zeros(40), rng.normal(size=200) * 9, [1e6]].astype(float)
    y = np.r_[rng.normal(size=300), np.ones(40), np.round(rng.normal(size=200), 1), [-1e6]].astype(float)
    for n, k in ((len(x), 3), (3, 3), (1, 3)):
        df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x[-n:], y[-n:])], "x double, y double").repartition(3)
        got = plane.reaches(df, k).collect()
        assert sum(r.c for r in got) == n
        for r in got:
            d = np.sort(np.maximum(np.abs(x[-n:] - r.x), np.abs(y[-n:] - r.y)))
            assert np.isclose(r.reach, d[min(k, n - 1)], rtol=1e-12, atol=0)
    assert len(plane.Tiles.fit(np.c_[x, y]).low) > 20
