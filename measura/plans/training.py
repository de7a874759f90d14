"""Queries that fit models (M). Fits have no SQL; their tests hold them to closed forms and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting, conformal, evaluate, joins, linear, metrics, models, prep, select, shapley, splits
from ..operators.models import Spec
from ..sources.store import written
from .registry import query
from .tables import r
from .views import FEAT, FEATURES, MAT, duck, table, view

FT = f"({duck(FEAT)})"
RIDGE = Spec("ridge", {"alpha": 1.0})


def ready(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """Complete feature rows with folds, inner folds and a split. Written once: every fit and every prediction reads them."""
    df = view(spark, sf_dir, FEAT).na.drop(subset=[*FEATURES, "y"])
    return written(df.withColumns({"fold": (F.col("id") % k).cast("int"), "inner": (F.floor(F.col("id") / k) % 2).cast("int"),
                                   "split": F.when(F.col("id") % 5 == 0, "test").otherwise("train")}), "ready")


# Complete rows in SQL, and the closed form of a ridge on x1 over a group of rows.
READY = f"(SELECT *, id % 3 AS fold, CASE WHEN id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM {FT} WHERE x1 + x2 + x3 + x4 + y IS NOT NULL)"
LINE = "avg(x1) AS mx, avg(y) AS my, covar_pop(x1, y) / (var_pop(x1) + 1.0 / count(*)) AS slope"


def two_features(a: str, b: str, y: str, rows: str, by: str = "") -> str:
    """The closed form of a ridge (alpha 1) on two columns over a group of rows: means and slopes."""
    head = f"{by}, " if by else ""
    v, w, c, d, e = f"(var_pop({a}) + 1.0 / count(*))", f"(var_pop({b}) + 1.0 / count(*))", f"covar_pop({a}, {b})", f"covar_pop({a}, {y})", f"covar_pop({b}, {y})"
    return f"""SELECT {head}avg({a}) AS ma, avg({b}) AS mb, avg({y}) AS my, ({d} * {w} - {e} * {c}) / ({v} * {w} - {c} * {c}) AS sa, ({e} * {v} - {d} * {c}) / ({v} * {w} - {c} * {c}) AS sb
        FROM {rows}{f" GROUP BY {by}" if by else ""}"""


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(r(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


@query("m02_power_scale")
def m02(spark, sf_dir):
    f = ready(spark, sf_dir)
    return _rounded(prep.PowerScaler.fit(f.where("split = 'train'"), ["x1", "x2"]).transform(f).select("id", "x1", "x2"))


@query("m02_given_powers", f"""WITH t AS (SELECT id, split, 2 * (sqrt(x1 + 1) - 1) AS a, ln(1 + x2) AS b, CASE WHEN x1 - 25 >= 0 THEN ((x1 - 24) ** 1.5 - 1) / 1.5 ELSE -2 * (sqrt(26 - x1) - 1) END AS c FROM {READY}),
    e AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, min(c) AS c0, max(c) AS c1 FROM t WHERE split = 'train')
    SELECT id, round((a - a0) / (a1 - a0), 6) AS x1, round((b - b0) / (b1 - b0), 6) AS x2, round((c - c0) / (c1 - c0), 6) AS x5 FROM t, e""")
def m02_given(spark, sf_dir):
    f = ready(spark, sf_dir).withColumn("x5", F.col("x1") - 25)
    return _rounded(prep.PowerScaler.at(f.where("split = 'train'"), {"x1": 0.5, "x2": 0.0, "x5": 1.5}).transform(f).select("id", "x1", "x2", "x5"))


@query("m04_ridge_one_feature", f"""SELECT id, round(my + c / (v + 5.0 / n) * (x1 - mx), 4) AS yhat FROM (SELECT id, x1 FROM {FT} WHERE y IS NOT NULL),
    (SELECT avg(x1) AS mx, avg(y) AS my, covar_pop(x1, y) AS c, var_pop(x1) AS v, count(*) AS n FROM {FT} WHERE y IS NOT NULL)""")
def m04(spark, sf_dir):
    f = ready(spark, sf_dir)
    return Spec("ridge", {"alpha": 5.0}).fit(f, ["x1"], "y").predict(f).select("id", r(F.col("yhat"), 4).alias("yhat"))


@query("m04_elastic_one_feature", f"""SELECT id, round(my + sign(c) * greatest(abs(c) - 20, 0) / (v + 20) * (x1 - mx), 4) AS yhat FROM (SELECT id, x1 FROM {FT} WHERE y IS NOT NULL),
    (SELECT avg(x1) AS mx, avg(y) AS my, covar_pop(x1, y) AS c, var_pop(x1) AS v FROM {FT} WHERE y IS NOT NULL AND x1 IS NOT NULL)""")
def m04_elastic(spark, sf_dir):
    f = view(spark, sf_dir, FEAT).where("y is not null")
    return Spec("elastic", {"alpha": 40.0, "mix": 0.5}).fit(f, ["x1"], "y").predict(f).select("id", r(F.col("yhat"), 4).alias("yhat"))


@query("m04_penalty_path")
def m04_path(spark, sf_dir):
    """Coefficients along a path of penalties, one scan for all of them."""
    found = linear.sums(ready(spark, sf_dir), FEATURES, "y", ["fold"])
    alphas = [100.0, 10.0, 1.0, 0.1]
    got = [(f, a, c, float(w)) for f in range(3) for a, m in zip(alphas, linear.path(linear.total([s for g, s in found.items() if g[0] != f]), alphas, 0.5)) for c, w in zip(FEATURES, m.weights)]
    return _rounded(spark.createDataFrame(got, "fold int, alpha double, feature string, weight double"), 5)


@query("m04_lasso")
def m04_lasso(spark, sf_dir):
    return _rounded(evaluate.holdout(ready(spark, sf_dir), Spec("lasso", {"alpha": 0.05}), FEATURES, "y"))


@query("m05_trees")
def m05(spark, sf_dir):
    f = ready(spark, sf_dir)
    return _rounded(evaluate.compare(f, [("tree", Spec("tree"), FEATURES), ("forest", Spec("forest", {"numTrees": 5}), FEATURES), ("boosting", Spec("boosting", {"maxIter": 3}), FEATURES)], "y", 2, "id"))


def stump(rows: str) -> str:
    """The cut between neighbouring values of x1 that leaves the least squared error, and the means on both sides, in SQL."""
    return f"""SELECT c, sl / nl AS low, (s - sl) / (n - nl) AS high FROM (SELECT c, count(*) FILTER (x1 <= c) AS nl, sum(y) FILTER (x1 <= c) AS sl, count(*) AS n, sum(y) AS s
        FROM {rows}, (SELECT (v + lead(v) OVER (ORDER BY v)) / 2 AS c FROM (SELECT DISTINCT x1 AS v FROM {rows})) WHERE c IS NOT NULL GROUP BY c) ORDER BY sl * sl / nl + (s - sl) ** 2 / (n - nl) DESC, c LIMIT 1"""


STUMP = {"maxDepth": 1, "maxBins": 64}


@query("m05_one_split", f"""WITH r AS (SELECT id, x1, y FROM {READY}), b AS ({stump("r")}) SELECT id, round(CASE WHEN x1 <= c THEN low ELSE high END, 4) AS yhat FROM r, b""")
def m05_one(spark, sf_dir):
    f = ready(spark, sf_dir)
    return Spec("tree", STUMP).fit(f, ["x1"], "y").predict(f).select("id", r(F.col("yhat"), 4).alias("yhat"))


@query("m06_random_features")
def m06(spark, sf_dir):
    return _rounded(evaluate.holdout(ready(spark, sf_dir), Spec("random_trees", {"trees": 5, "depth": 4}), FEATURES, "y"))


# One-level trees with random thresholds on all features: the best cut of each tree, and the means of its sides.
LONG = f"(SELECT id, y, unnest([x1, x2, x3, x4]) AS x, unnest([0, 1, 2, 3]) AS f FROM {READY})"
STUMPS = f"""c AS (SELECT t, f, lo + ('0x' || substr(md5(concat('42:', t, ':1:x', f + 1)), 1, 8))::bigint / 4294967296.0::double * (hi - lo) AS c
        FROM (SELECT f, min(x) AS lo, max(x) AS hi FROM {LONG} GROUP BY f), (SELECT unnest([0, 1, 2]) AS t)),
    g AS (SELECT t, f, c, count(*) FILTER (x <= c) AS nl, sum(y) FILTER (x <= c) AS sl, count(*) AS n, sum(y) AS s FROM {LONG} JOIN c USING (f) GROUP BY t, f, c),
    b AS (SELECT t, f, c, sl / nl AS low, (s - sl) / (n - nl) AS high, s / n AS mean FROM g WHERE nl BETWEEN 1 AND n - 1
        QUALIFY row_number() OVER (PARTITION BY t ORDER BY sl * sl / nl + (s - sl) ** 2 / (n - nl) DESC) = 1)"""


@query("m06_one_level", f"""WITH {STUMPS} SELECT id, round(avg(CASE WHEN x <= c THEN low ELSE high END), 4) AS yhat FROM {LONG} JOIN b USING (f) GROUP BY id""")
def m06_one(spark, sf_dir):
    f = ready(spark, sf_dir)
    return Spec("random_trees", {"trees": 3, "depth": 1, "subset": None, "seed": 42}).fit(f, FEATURES, "y").predict(f).select("id", r(F.col("yhat"), 4).alias("yhat"))


@query("a24_signed_boosting")
def a24_boosting(spark, sf_dir):
    """Held-out metrics of boosting whose predictions may only rise in x1 and only fall in x4, beside the free model."""
    f = ready(spark, sf_dir)
    free = {"stages": 4, "depth": 2, "rate": 0.3}
    entries = [("free", Spec("signed_boosting", free), FEATURES), ("signed", Spec("signed_boosting", free | {"signs": {"x1": 1, "x4": -1}}), FEATURES)]
    return _rounded(evaluate.compare(f, entries, "y", 2, "id"))


@query("m07_weight_scan")
def m07(spark, sf_dir):
    f = ready(spark, sf_dir)
    return _rounded(evaluate.weight_scan(f.where("id % 2 = 0"), {"bridge": f.where("id % 2 = 1").withColumn("y", F.col("y") + 5)}, [0.2, 0.8], FEATURES, "y", 3, "id"))


@query("m07_one_feature", f"""WITH g AS (SELECT * FROM {READY}), a AS (SELECT unnest([0.2::double, 0.8]) AS w), k AS (SELECT unnest([0, 1]) AS f),
    t AS (SELECT w, f, x1, y, 1.0::double AS u FROM g, a, k WHERE id % 2 = 0 AND fold <> f UNION ALL SELECT w, f, x1, y + 5, w FROM g, a, k WHERE id % 2 = 1),
    m AS (SELECT w, f, sum(u * x1) / sum(u) AS mx, sum(u * y) / sum(u) AS my FROM t GROUP BY w, f),
    s AS (SELECT w, f, any_value(mx) AS mx, any_value(my) AS my, sum(u * (x1 - mx) * (y - my)) / (sum(u * (x1 - mx) ** 2) + 1) AS slope FROM t JOIN m USING (w, f) GROUP BY w, f),
    p AS (SELECT w, f, 1 - avg((my + slope * (x1 - mx) - y) ** 2) / var_pop(y) AS r2, avg(abs(my + slope * (x1 - mx) - y)) AS mae FROM g JOIN s ON fold = f WHERE id % 2 = 0 GROUP BY w, f),
    q AS (SELECT w, avg(r2) AS r2_mean, avg(mae) AS mae_mean FROM p GROUP BY w)
    SELECT CASE WHEN w < 0.5 THEN 'w=0.2' ELSE 'w=0.8' END AS model, round(r2_mean, 5) AS r2_mean, round(mae_mean, 5) AS mae_mean, r2_mean > 0 AND row_number() OVER (ORDER BY r2_mean DESC, w) = 1 AS best FROM q""")
def m07_one(spark, sf_dir):
    f = ready(spark, sf_dir)
    got = evaluate.weight_scan(f.where("id % 2 = 0"), {"bridge": f.where("id % 2 = 1").withColumn("y", F.col("y") + 5)}, [0.2, 0.8], ["x1"], "y", 2, "id", scale=False)
    return _rounded(got.select("model", "r2_mean", "mae_mean", "best"), 5)


@query("m08_two_stage")
def m08(spark, sf_dir):
    f = ready(spark, sf_dir)
    got = models.two_stage(f.where("id % 2 = 1 and split = 'train'"), f.where("id % 2 = 0 and split = 'train'"), f.where("split = 'test'"), FEATURES, "y", 3, 8)
    return _rounded(got.select("id", "a", "b", "yhat"))


@query("m08_one_split_each", f"""WITH v AS (SELECT x1, y FROM {READY} WHERE id % 2 = 1 AND split = 'train'), g AS (SELECT x1, y FROM {READY} WHERE id % 2 = 0 AND split = 'train'), a AS ({stump("v")}), b AS ({stump("g")})
    SELECT id, round((3 * CASE WHEN x1 <= a.c THEN a.low ELSE a.high END + 5 * CASE WHEN x1 <= b.c THEN b.low ELSE b.high END) / 8, 4) AS yhat FROM {READY}, a, b WHERE split = 'test'""")
def m08_one(spark, sf_dir):
    f = ready(spark, sf_dir)
    got = models.two_stage(f.where("id % 2 = 1 and split = 'train'"), f.where("id % 2 = 0 and split = 'train'"), f.where("split = 'test'"), ["x1"], "y", 3, 8, bootstrap=False, **STUMP)
    return got.select("id", r(F.col("yhat"), 4).alias("yhat"))


MIXED_AT = [0.1, 0.3, 0.5, 0.7, 0.9]


def _gold(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, MAT).select("k", (F.col("raw") / 1000).alias("x"), F.col("t").alias("y"), (F.col("k") % 3).cast("int").alias("fold"))


def _virtual(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Materials and a row for each of their mixtures; M09 sums these without making them."""
    m = view(spark, sf_dir, MAT).withColumn("x", F.col("raw") / 1000)
    gold = _gold(spark, sf_dir)
    pairs = joins.material_pairs(m.withColumn("fold", (F.col("k") % 3).cast("int")), "k", "t", ("x", "fold"))
    v = joins.weight_grid(m, "k", "t", MIXED_AT, pairs=pairs)
    return gold, v.select("k1", "k2", "fold1", "fold2", (F.col("w1") * F.col("x1") + (1 - F.col("w1")) * F.col("x2")).alias("x"), F.col("mixed").alias("y"))


@query("m09_leak_free_cv")
def m09(spark, sf_dir):
    got = evaluate.leak_free_mixtures(_gold(spark, sf_dir), MIXED_AT, RIDGE, "x", "y", 3, "k", weight=0.1, trees=(3, 8), scale=True)
    return _rounded(metrics.fold_summary(got, "y", "yhat"))


@query("m09_closed_form", f"""WITH g AS (SELECT k, raw / 1000 AS x, t AS y, k % 3 AS fold FROM ({duck(MAT)})),
    v AS (SELECT a.fold AS fa, b.fold AS fb, w * a.x + (1 - w) * b.x AS x, round(1 / (w / a.y + (1 - w) / b.y), 2) AS y FROM g a JOIN g b ON a.k < b.k, (SELECT unnest([0.1::double, 0.3, 0.5, 0.7, 0.9]) AS w) WHERE a.y > 0 AND b.y > 0),
    f AS (SELECT unnest([0, 1, 2]) AS f), t AS (SELECT 'baseline' AS model, f, x, y FROM g, f WHERE fold <> f UNION ALL SELECT 'virtual', f, x, y FROM g, f WHERE fold <> f UNION ALL SELECT 'virtual', f, x, y FROM v, f WHERE fa <> f AND fb <> f),
    s AS (SELECT model, f, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / (var_pop(x) + 1.0 / count(*)) AS slope FROM t GROUP BY model, f),
    p AS (SELECT model, f, 1 - avg((my + slope * (x - mx) - y) ** 2) / var_pop(y) AS r2, avg(abs(my + slope * (x - mx) - y)) AS mae FROM g JOIN s ON fold = f GROUP BY model, f)
    SELECT model, round(avg(r2), 6) AS r2_mean, round(avg(mae), 5) AS mae_mean FROM p GROUP BY model""")
def m09_closed(spark, sf_dir):
    got = metrics.fold_summary(evaluate.leak_free_mixtures(_gold(spark, sf_dir), MIXED_AT, RIDGE, "x", "y", 3, "k"), "y", "yhat")
    return got.select("model", r(F.col("r2_mean")).alias("r2_mean"), r(F.col("mae_mean"), 5).alias("mae_mean"))


@query("m10_stacking")
def m10(spark, sf_dir):
    oof, meta = models.stack(ready(spark, sf_dir, 2), {"ridge": (RIDGE, FEATURES), "tree": (Spec("tree"), FEATURES)}, "y", 2)
    return _rounded(meta.predict(oof).select("id", "oof_ridge", "oof_tree", "yhat"))


@query("m10_one_feature_each", f"""WITH r AS (SELECT id, x1, x3, y, id % 2 AS fold FROM {READY}), k AS (SELECT unnest([0, 1]) AS f),
    l AS (SELECT f, avg(x1) AS m1, avg(x3) AS m3, avg(y) AS my, covar_pop(x1, y) / (var_pop(x1) + 1.0 / count(*)) AS s1, covar_pop(x3, y) / (var_pop(x3) + 1.0 / count(*)) AS s3 FROM r, k WHERE fold <> f GROUP BY f),
    o AS (SELECT id, y, my + s1 * (x1 - m1) AS a, my + s3 * (x3 - m3) AS b FROM r JOIN l ON fold = f), j AS ({two_features("a", "b", "y", "o")})
    SELECT id, round(a, 4) AS oof_a, round(b, 4) AS oof_b, round(my + sa * (a - ma) + sb * (b - mb), 4) AS yhat FROM o, j""")
def m10_one(spark, sf_dir):
    oof, meta = models.stack(ready(spark, sf_dir, 2), {"a": (RIDGE, ["x1"]), "b": (RIDGE, ["x3"])}, "y", 2)
    return _rounded(meta.predict(oof).select("id", "oof_a", "oof_b", "yhat"), 4)


@query("m11_expert_committee")
def m11(spark, sf_dir):
    experts = {"size": (RIDGE, ["x1", "x2"]), "use": (Spec("tree", {"maxDepth": 3}), ["x3", "x4"])}
    oof, meta = models.stack(ready(spark, sf_dir, 2), experts, "y", 2, ["x1"], Spec("elastic", {"alpha": 0.01, "mix": 0.5}))
    return _rounded(meta.predict(oof).select("id", "oof_size", "oof_use", "yhat"))


@query("m11_committee_cv")
def m11_cv(spark, sf_dir):
    experts = {"size": (RIDGE, ["x1", "x2"]), "use": (Spec("tree", {"maxDepth": 3}), ["x3", "x4"]), "parts": (RIDGE, ["c0", "c1"])}
    got = evaluate.committee_cv(ready(spark, sf_dir, 2), experts, "y", 2, "id", ["x1"], {"c": (["x2", "x3", "x4"], 2)}, meta=Spec("elastic", {"alpha": 0.01, "mix": 0.5}))
    return _rounded(metrics.fold_summary(got, "y", "yhat"))


@query("m11_linear_experts", f"""WITH r AS (SELECT id, x1, x3, y, id % 2 AS fold FROM {READY}), k AS (SELECT unnest([0, 1]) AS f),
    l AS (SELECT f, avg(x1) AS m1, avg(y) AS my, covar_pop(x1, y) / (var_pop(x1) + 1.0 / count(*)) AS s1 FROM r, k WHERE fold <> f GROUP BY f),
    n AS (SELECT id, y, my + s1 * (x1 - m1) AS a FROM r JOIN l ON fold = f),
    j AS (SELECT avg(a) AS ma, avg(y) AS my, covar_pop(a, y) AS c, var_pop(a) AS v FROM n)
    SELECT id, round(my + sign(c) * greatest(abs(c) - 10, 0) / (v + 10) * (a - ma), 4) AS yhat FROM n, j""")
def m11_linear(spark, sf_dir):
    """One expert and an elastic-net judge."""
    oof, meta = models.stack(ready(spark, sf_dir, 2), {"a": (RIDGE, ["x1"])}, "y", 2, meta=Spec("elastic", {"alpha": 20.0, "mix": 0.5}))
    return _rounded(meta.predict(oof).select("id", "yhat"), 4)


@query("m12_linear_layers", f"""WITH r AS (SELECT id, x1, x3, y, split FROM {READY}), a AS (SELECT avg(x1) AS m, avg(y) AS my, covar_pop(x1, y) / (var_pop(x1) + 1.0 / count(*)) AS s FROM r WHERE split = 'train'),
    p AS (SELECT r.*, my + s * (x1 - m) AS part0, y - (my + s * (x1 - m)) AS e0 FROM r, a), b AS (SELECT avg(x3) AS m, avg(e0) AS my, covar_pop(x3, e0) / (var_pop(x3) + 1.0 / count(*)) AS s FROM p WHERE split = 'train'),
    q AS (SELECT p.*, my + s * (x3 - m) AS part1, e0 - (my + s * (x3 - m)) AS e1 FROM p, b), c AS ({two_features("x1", "x3", "e1", "q WHERE split = 'train'")})
    SELECT id, round(part0, 4) AS part0, round(part1, 4) AS part1, round(my + sa * (x1 - ma) + sb * (x3 - mb), 4) AS part2, round(part0 + part1 + my + sa * (x1 - ma) + sb * (x3 - mb), 4) AS yhat FROM q, c WHERE split = 'test'""")
def m12_linear(spark, sf_dir):
    f = ready(spark, sf_dir)
    got = models.hierarchical(f.where("split = 'train'"), f.where("split = 'test'"), [["x1"], ["x3"]], "y", RIDGE)
    return _rounded(got.select("id", "part0", "part1", "part2", "yhat"), 4)


@query("m12_hierarchical_cv")
def m12_cv(spark, sf_dir):
    f = ready(spark, sf_dir, 2)
    got = evaluate.repeated(f, "id", 2, 2, lambda df: evaluate.hierarchical_cv(df, [["x1"], ["x2"], ["x3", "x4"]], "y", 2, "id", Spec("boosting", {"maxIter": 2})))
    return _rounded(metrics.fold_summary(got, "y", "yhat"))


@query("m12_hierarchical")
def m12(spark, sf_dir):
    f = ready(spark, sf_dir)
    got = models.hierarchical(f.where("split = 'train'"), f.where("split = 'test'"), [["x1"], ["x2"], ["x3", "x4"]], "y", Spec("boosting", {"maxIter": 2}))
    return _rounded(got.select("id", "part0", "part1", "part2", "part3", "yhat"))


@query("m13_nested_cv")
def m13(spark, sf_dir):
    got, _ = evaluate.nested_cv(ready(spark, sf_dir, 2), "ridge", {"alpha": [0.1, 10.0, 1000.0]}, FEATURES, "y", "id", 2, 2)
    return _rounded(metrics.fold_summary(got, "y", "yhat"))


@query("m13_one_feature", f"""WITH r AS (SELECT id, x1, y, id % 2 AS fold, id // 2 % 2 AS inr FROM {FT} WHERE x1 + x2 + x3 + x4 + y IS NOT NULL), a AS (SELECT unnest([0.1::double, 1000, 100000]) AS alpha), g AS (SELECT unnest([0, 1]) AS f),
    i AS (SELECT f, alpha, h, avg(x1) AS mx, avg(y) AS my, covar_pop(x1, y) / (var_pop(x1) + alpha / count(*)) AS slope FROM r, g, a, (SELECT unnest([0, 1]) AS h) WHERE fold <> f AND inr <> h GROUP BY f, alpha, h),
    s AS (SELECT f, alpha, 1 - avg((my + slope * (x1 - mx) - y) ** 2) / var_pop(y) AS r2 FROM r JOIN i ON fold <> f AND inr = h GROUP BY f, alpha),
    b AS (SELECT f, arg_max(alpha, r2) AS alpha FROM s GROUP BY f),
    o AS (SELECT f, any_value(alpha) AS alpha, avg(x1) AS mx, avg(y) AS my, covar_pop(x1, y) / (var_pop(x1) + any_value(alpha) / count(*)) AS slope FROM r JOIN b ON fold <> f GROUP BY f)
    SELECT id, fold::int AS fold, round(my + slope * (x1 - mx), 4) AS yhat FROM r JOIN o ON fold = f""")
def m13_one(spark, sf_dir):
    got, _ = evaluate.nested_cv(ready(spark, sf_dir, 2), "ridge", {"alpha": [0.1, 1000.0, 100000.0]}, ["x1"], "y", "id", 2, 3)
    return _rounded(got.select("id", "fold", "yhat"), 4)


@query("m13_repeated_nested_cv")
def m13_repeated(spark, sf_dir):
    grid = {"alpha": [0.1, 10.0, 1000.0]}
    got = evaluate.repeated(ready(spark, sf_dir, 2), "id", 2, 2, lambda df: evaluate.nested_cv(df, "ridge", grid, FEATURES, "y", "id", 2, 2)[0])
    return _rounded(metrics.fold_summary(got, "y", "yhat"))


@query("m14_repeated_cv")
def m14_repeated(spark, sf_dir):
    return _rounded(evaluate.repeated(ready(spark, sf_dir), "id", 3, 2, lambda df: evaluate.cross_validate(df, RIDGE, FEATURES, "y", 3, "id")))


@query("m14_cross_validate")
def m14(spark, sf_dir):
    return _rounded(evaluate.cross_validate(ready(spark, sf_dir), RIDGE, FEATURES, "y", 3, "id"))


@query("m14_ridge_one_feature", f"""SELECT 'model' AS model, fold::int AS fold, id, round(my + slope * (x1 - mx), 4) AS yhat FROM {READY} JOIN
    (SELECT f, {LINE} FROM {READY}, (SELECT unnest([0, 1, 2]) AS f) WHERE fold <> f GROUP BY f) ON f = fold""")
def m14_one(spark, sf_dir):
    return _rounded(evaluate.cross_validate(ready(spark, sf_dir), RIDGE, ["x1"], "y", 3, "id").drop("y"), 4)


@query("m14_ridge_two_features", f"""SELECT fold::int AS fold, id, round(my + ((c1 * v3 - c3 * c13) * (x1 - m1) + (c3 * v1 - c1 * c13) * (x3 - m3)) / (v1 * v3 - c13 * c13), 4) AS yhat FROM {READY} JOIN
    (SELECT f, avg(x1) AS m1, avg(x3) AS m3, avg(y) AS my, var_pop(x1) + 1.0 / count(*) AS v1, var_pop(x3) + 1.0 / count(*) AS v3, covar_pop(x1, x3) AS c13, covar_pop(x1, y) AS c1, covar_pop(x3, y) AS c3
     FROM {READY}, (SELECT unnest([0, 1, 2]) AS f) WHERE fold <> f GROUP BY f) ON f = fold""")
def m14_two(spark, sf_dir):
    return _rounded(evaluate.cross_validate(ready(spark, sf_dir), RIDGE, ["x1", "x3"], "y", 3, "id").select("fold", "id", "yhat"), 4)


@query("m15_ridge_one_feature", f"""SELECT split, count(*) AS n, round(1 - avg((yhat - y) ** 2) / var_pop(y), 5) AS r2, round(avg(abs(yhat - y)), 5) AS mae, round(sqrt(avg((yhat - y) ** 2)), 5) AS rmse,
    round(100 * avg(abs((yhat - y) / y)), 5) AS mape FROM (SELECT split, y, my + slope * (x1 - mx) AS yhat FROM {READY}, (SELECT {LINE} FROM {READY} WHERE split = 'train')) GROUP BY split""")
def m15_one(spark, sf_dir):
    return _rounded(evaluate.holdout(ready(spark, sf_dir), RIDGE, ["x1"], "y"), 5)


@query("m15_holdout")
def m15(spark, sf_dir):
    return _rounded(evaluate.holdout(ready(spark, sf_dir), RIDGE, FEATURES, "y"))


@query("m16_feature_ablation")
def m16(spark, sf_dir):
    subsets = {"x1": ["x1"], "x1+x2": ["x1", "x2"], "x1..x3": ["x1", "x2", "x3"], "all": FEATURES}
    return _rounded(evaluate.compare(ready(spark, sf_dir), [(n, RIDGE, c) for n, c in subsets.items()], "y", 2, "id"))


@query("m16_two_entries", f"""WITH r AS (SELECT * FROM {READY}), k AS (SELECT unnest([0, 1]) AS f), l AS (SELECT 'x1' AS model, id, fold, x1 AS x, y FROM r UNION ALL SELECT 'x3', id, fold, x3, y FROM r),
    s AS (SELECT model, f, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / (var_pop(x) + 1.0 / count(*)) AS slope FROM l, k WHERE fold <> f GROUP BY model, f),
    p AS (SELECT l.model AS model, f, 1 - avg((my + slope * (x - mx) - y) ** 2) / var_pop(y) AS r2 FROM l JOIN s ON l.model = s.model AND fold = f GROUP BY l.model, f), m AS (SELECT model, avg(r2) AS r2, stddev_pop(r2) AS d FROM p GROUP BY model)
    SELECT model, round(r2, 6) AS r2_mean, round(d, 6) AS r2_std, round(r2 - (SELECT r2 FROM m WHERE model = 'x1'), 6) AS delta, (rank() OVER (ORDER BY r2 DESC))::int AS rank FROM m""")
def m16_two(spark, sf_dir):
    got = evaluate.compare(ready(spark, sf_dir), [("x1", RIDGE, ["x1"]), ("x3", RIDGE, ["x3"])], "y", 2, "id")
    return _rounded(got.select("model", "r2_mean", "r2_std", "delta", "rank"))


@query("m17_two_columns", """WITH e AS (SELECT vec_id, embedding[1]::double AS a, embedding[2]::double AS b FROM embeddings), c AS (SELECT var_samp(a) AS v, var_samp(b) AS w, covar_samp(a, b) AS c FROM e WHERE vec_id % 5 <> 0),
    l AS (SELECT v, c, (v + w) / 2 + sqrt(((v - w) / 2) ** 2 + c * c) AS l FROM c), d AS (SELECT c / sqrt(c * c + (l - v) ** 2) AS x, (l - v) / sqrt(c * c + (l - v) ** 2) AS y FROM l)
    SELECT vec_id, round(abs(x * a + y * b), 5) AS pc0, round(abs(x * b - y * a), 5) AS pc1 FROM e, d""")
def m17_two(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(2)))
    got = prep.Components.fit(e.where("vec_id % 5 <> 0"), ["e0", "e1"], 2).transform(e)
    return _rounded(got.select("vec_id", F.abs("pc0").alias("pc0"), F.abs("pc1").alias("pc1")), 5)


@query("m17_pca")
def m17(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)))
    e = e.withColumn("e3", F.when(F.col("vec_id") % 17 != 0, F.col("e3")))
    return _rounded(prep.Components.fit(e.where("vec_id % 5 <> 0"), [f"e{i}" for i in range(64)], 3).transform(e).select("vec_id", *(F.abs(f"pc{i}").alias(f"pc{i}") for i in range(3))), 5)


@query("m18_boruta")
def m18(spark, sf_dir):
    """All rows' values of the features that are kept, with the decisions, summed up by feature."""
    f = ready(spark, sf_dir)
    found = select.boruta(f, "id", FEATURES, "y", rounds=8, trees=10)
    decided = spark.createDataFrame([(c, d, found.hits[c], found.rounds[c]) for c, d in found.decision.items()], "feature string, decision string, hits int, rounds int")
    rows = select.selected_rows(f, "id", found.kept).groupBy("feature").agg(F.count("value").alias("n"), r(F.avg("value")).alias("mean"))
    return decided.join(rows, "feature", "left")


@query("m19_information", f"""WITH r AS (SELECT id, y / (SELECT stddev_pop(y) FROM {READY}) AS y, x1 / (SELECT stddev_pop(x1) FROM {READY}) AS x1, x3 / (SELECT stddev_pop(x3) FROM {READY}) AS x3 FROM {READY}),
    l AS (SELECT id, y, 'x1' AS feature, x1 AS x FROM r UNION ALL SELECT id, y, 'x3', x3 FROM r),
    n AS (SELECT a.feature AS feature, a.id AS id, any_value(a.x) AS x, any_value(a.y) AS y, list_sort(list(greatest(abs(a.x - b.x), abs(a.y - b.y))))[3] * (1 - 1e-10) AS reach FROM l a JOIN l b ON a.feature = b.feature AND a.id <> b.id GROUP BY a.feature, a.id),
    c AS (SELECT n.feature AS feature, n.id AS id, count(*) FILTER (b.x >= n.x - reach AND b.x <= n.x + reach) AS nx, count(*) FILTER (b.y >= n.y - reach AND b.y <= n.y + reach) AS ny FROM n JOIN l b ON b.feature = n.feature GROUP BY n.feature, n.id),
    h AS (SELECT k, sum(1.0::double / k) OVER (ORDER BY k) - 1.0::double / k - 0.5772156649015329 AS psi FROM (SELECT unnest(range(1, 100001)) AS k))
    SELECT feature, round(greatest((SELECT psi FROM h WHERE k = (SELECT count(*) FROM r)) + (SELECT psi FROM h WHERE k = 3) - avg(p.psi) - avg(q.psi), 0), 5) AS information FROM c JOIN h p ON p.k = nx JOIN h q ON q.k = ny GROUP BY feature""")
def m19_information(spark, sf_dir):
    return _rounded(select.neighbour_information(ready(spark, sf_dir), ["x1", "x3"], "y"), 5)


@query("m19_mrmr")
def m19(spark, sf_dir):
    """All rows' values of the chosen features, summed up by place of choice."""
    f = ready(spark, sf_dir)
    found = select.mrmr_steps(f, FEATURES, "y", 3)
    scores = spark.createDataFrame(found, "feature string, relevance double, score double")
    rows = select.selected_rows(f, "id", [c for c, _, _ in found]).groupBy("place", "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return _rounded(rows.join(scores, "feature"), 5)


@query("m20_importance")
def m20(spark, sf_dir):
    """Mean absolute Shapley values of a forest over all rows."""
    f = ready(spark, sf_dir)
    model = shapley.model_trees(Spec("forest", {"numTrees": 5}).fit(f, FEATURES, "y").model, FEATURES, f)
    return _rounded(shapley.shapley_ranking(model, f), 5)


@query("m20_shapley_values")
def m20_values(spark, sf_dir):
    """Every row's Shapley values under boosted trees, and what they add up to."""
    f = ready(spark, sf_dir)
    model = shapley.model_trees(Spec("boosting", {"maxIter": 3}).fit(f.where("split = 'train'"), FEATURES, "y").model, FEATURES, f.where("split = 'train'"))
    got = shapley.shapley_values(model, f)
    return _rounded(got.select("id", "yhat", "mean", *(F.col("shapley")[k].alias(c) for k, c in enumerate(FEATURES)), (F.aggregate("shapley", F.col("mean"), lambda s, x: s + x) - F.col("yhat")).alias("rest")), 5)


@query("m20_shapley_one_level", f"""WITH {STUMPS}, v AS (SELECT id, f, sum((CASE WHEN x <= c THEN low ELSE high END - mean) / 3) AS v FROM {LONG} JOIN b USING (f) GROUP BY id, f), i AS (SELECT f, avg(abs(v)) AS i FROM v GROUP BY f)
    SELECT concat('x', f + 1) AS feature, round(coalesce(i, 0), 4) AS importance FROM (SELECT unnest([0, 1, 2, 3]) AS f) LEFT JOIN i USING (f)""")
def m20_one(spark, sf_dir):
    f = ready(spark, sf_dir)
    model = Spec("random_trees", {"trees": 3, "depth": 1, "subset": None, "seed": 42}).fit(f, FEATURES, "y").model
    return _rounded(shapley.shapley_ranking(model, f).drop("place"), 4)


@query("m20_permutation_one_feature", f"""WITH p AS (SELECT y, x1, row_number() OVER (ORDER BY md5(concat('7:', id)), id) AS k, row_number() OVER (ORDER BY md5(concat('7:x1:', id)), id) AS l FROM {READY}), m AS (SELECT {LINE} FROM {READY}),
    j AS (SELECT a.y AS y, my + slope * (a.x1 - mx) AS p, my + slope * (b.x1 - mx) AS q FROM p a JOIN p b ON a.k = b.l, m)
    SELECT 'x1' AS feature, round(1 - avg((p - y) ** 2) / var_pop(y), 5) AS r2, round(1 - avg((q - y) ** 2) / var_pop(y), 5) AS permuted_r2 FROM j""")
def m20_permutation_one(spark, sf_dir):
    f = ready(spark, sf_dir)
    return _rounded(shapley.permutation_importance(RIDGE.fit(f, ["x1"], "y"), f, "id", "y").select("feature", "r2", "permuted_r2"), 5)


@query("m20_permutation")
def m20_permutation(spark, sf_dir):
    f = ready(spark, sf_dir)
    return _rounded(shapley.permutation_importance(Spec("forest", {"numTrees": 5}).fit(f, FEATURES, "y"), f, "id", "y"), 5)


@query("m20_top_k_curve")
def m20_curve(spark, sf_dir):
    """Validation of the k features with the largest Shapley values, for each k."""
    f = ready(spark, sf_dir)
    return _rounded(select.top_k_curve(f, FEATURES, "y", [1, 2, 3, 4], "id", 2, RIDGE, Spec("random_trees", {"trees": 5, "depth": 4})))


@query("m21_selection_pipeline")
def m21(spark, sf_dir):
    """All rows' values of the features that the stages leave, and how many each stage left."""
    f = ready(spark, sf_dir)
    kept, log = select.selection_pipeline(f, "id", FEATURES, "y", 2, many=3, rounds=4)
    left = ", ".join(f"{name} {before}-{after}" for name, before, after in log)
    return _rounded(select.selected_rows(f, "id", kept).withColumn("stages", F.lit(left)))


@query("m22_ridge_one_feature", f"""WITH p AS (SELECT *, my + slope * (x1 - mx) AS p FROM {READY}, (SELECT {LINE} FROM {READY} WHERE fold = 0)),
    e AS (SELECT list_sort(list(abs(y - p))) AS e, (count(*) - 1) * least(ceil((count(*) + 1) * 0.9::double) / count(*), 1) AS h FROM p WHERE fold = 1),
    q AS (SELECT e[floor(h)::int + 1] * (1 - h + floor(h)) + e[ceil(h)::int + 1] * (h - floor(h)) AS q FROM e)
    SELECT id, round(p, 4) AS yhat, round(p - q, 4) AS low, round(p + q, 4) AS high FROM p, q WHERE fold = 2""")
def m22_one(spark, sf_dir):
    f = ready(spark, sf_dir)
    got = conformal.split_conformal(f.where("fold = 0"), f.where("fold = 1"), f.where("fold = 2"), RIDGE, ["x1"], "y", 0.9)
    return _rounded(got.select("id", "yhat", "low", "high"), 4)


@query("m22_split_conformal")
def m22(spark, sf_dir):
    f = ready(spark, sf_dir)
    got = conformal.split_conformal(f.where("fold = 0"), f.where("fold = 1"), f.where("fold = 2"), RIDGE, FEATURES, "y")
    return _rounded(got.select("id", "y", "yhat", "low", "high"))


@query("m23_cross_conformal")
def m23(spark, sf_dir):
    f = ready(spark, sf_dir)
    return _rounded(conformal.cross_conformal(f.where("split = 'train'"), f.where("split = 'test'"), RIDGE, FEATURES, "y", "id", 3))


@query("m23_one_feature", f"""WITH t AS (SELECT * FROM {READY} WHERE split = 'train'), k AS (SELECT unnest([0, 1, 2]) AS f), s AS (SELECT f, {LINE} FROM t, k WHERE fold <> f GROUP BY f),
    e AS (SELECT f, abs(y - (my + slope * (x1 - mx))) AS e FROM t JOIN s ON fold = f), p AS (SELECT id, y, f, my + slope * (x1 - mx) AS p FROM {READY}, s WHERE split = 'test'), m AS (SELECT id, avg(p) AS yhat FROM p GROUP BY id)
    SELECT id, any_value(y) AS y, round(any_value(yhat), 4) AS yhat, round(quantile_cont(p - e, 0.1::double), 4) AS low, round(quantile_cont(p + e, 0.9::double), 4) AS high FROM p JOIN e USING (f) JOIN m USING (id) GROUP BY id""")
def m23_one(spark, sf_dir):
    f = ready(spark, sf_dir)
    got = conformal.cross_conformal(f.where("split = 'train'"), f.where("split = 'test'"), RIDGE, ["x1"], "y", "id", 3)
    return got.select("id", "y", *(r(F.col(c), 4).alias(c) for c in ("yhat", "low", "high")))


@query("m24_conformal_quantiles")
def m24(spark, sf_dir):
    f = ready(spark, sf_dir)
    got = conformal.conformalized_quantiles(f.where("fold = 0"), f.where("fold = 1"), f.where("fold = 2"), FEATURES, "y", stages=3, depth=2)
    return _rounded(got.select("id", "y", "yhat", "low", "high"))


@query("m24_one_stage", f"""WITH r AS (SELECT id, x3 AS x, y FROM {READY}), s AS (SELECT quantile_cont(y, 0.8::double) AS s FROM r), g AS (SELECT id, x, y - s AS d, CASE WHEN y > s THEN 0.8::double ELSE -0.2::double END AS g FROM r, s),
    e AS (SELECT DISTINCT unnest(quantile_cont(x, [0.25, 0.5, 0.75])) AS e FROM r),
    c AS (SELECT e FROM (SELECT e, count(*) FILTER (x <= e) AS nl, sum(g) FILTER (x <= e) AS sl, count(*) AS n, sum(g) AS s FROM g, e GROUP BY e) WHERE nl >= 20 AND n - nl >= 20 ORDER BY sl * sl / nl + (s - sl) ** 2 / (n - nl) DESC, e LIMIT 1),
    q AS (SELECT x <= e AS side, quantile_cont(d, 0.8::double) AS q FROM g, c GROUP BY side)
    SELECT id, round(s + q, 4) AS yhat FROM g, c, s JOIN q ON side = (x <= e)""")
def m24_one(spark, sf_dir):
    f = ready(spark, sf_dir)
    model = boosting.quantile_boosting(f, ["x3"], "y", [0.8], stages=1, rate=1.0, depth=1, bins=4)[0]
    return model.predict(f).select("id", r(F.col("yhat"), 4).alias("yhat"))


@query("m24_pinball_loss")
def m24_loss(spark, sf_dir):
    """Held-out pinball loss and coverage of boosted quantile models."""
    f = ready(spark, sf_dir)
    levels = [0.1, 0.5, 0.9]
    models = boosting.quantile_boosting(f.where("split = 'train'"), FEATURES, "y", levels, stages=3, depth=2)
    test = f.where("split = 'test'").withColumns({f"q{k}": m.column() for k, m in enumerate(models)})
    return _rounded(test.agg(*(boosting.pinball_loss("y", f"q{k}", q).alias(f"loss{k}") for k, q in enumerate(levels)), F.avg(F.col("y").between(F.col("q0"), F.col("q2")).cast("int")).alias("covered")), 5)


@query("m25_early_stopping")
def m25(spark, sf_dir):
    f = ready(spark, sf_dir).withColumn("held", F.col("fold") == 2)
    got = Spec("boosting", {"maxIter": 10, "validationTol": 0.01}, validation="held").fit(f.where("split = 'train'"), FEATURES, "y")
    return _rounded(got.predict(f.where("split = 'test'")).select("id", "y", "yhat"))
