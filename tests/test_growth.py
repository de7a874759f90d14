"""Work that must not grow faster than the rows: what queries shuffle and how often they read their input."""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from measura.operators import conformal, evaluate, joins, metrics, mixtures, prep, quality, select, shapley, splits, trees
from measura.operators.models import Spec


def shuffled_records(spark):
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages, total = spark._jsc.sc().statusStore().stageList(None, False, False, none, None).iterator(), 0
    while stages.hasNext():
        total += stages.next().shuffleWriteRecords()
    return total


def test_cross_conformal_does_not_pair_rows_with_residuals(spark, monkeypatch):
    """all test rows want the same few ranges, so each met the same residuals as rows of its own."""
    rng = np.random.default_rng(3)
    n = 1500
    x, y = rng.normal(size=n), rng.normal(size=n).round(2)
    rows = [(i, float(x[i]), float(y[i]), i % 3, i % 2) for i in range(n)] + [(n, None, 1.0, 0, 1), (n + 1, 0.5, None, 0, 1), (n + 1, 0.5, None, 0, 1)]
    df = spark.createDataFrame(rows, "id long, x double, y double, fold int, test int").repartition(2).cache()
    train, test = df.where("test = 0"), df.where("test = 1")
    monkeypatch.setattr(conformal, "CHUNK", 400, raising=False)  # rows of one cell in several groups
    before = shuffled_records(spark)
    got = conformal.cross_conformal(train, test, Spec("ridge"), ["x"], "y", "id", 3, levels=2).collect()
    assert shuffled_records(spark) - before < 40 * n
    values, heights = [], {}
    for f in range(3):
        fitted = Spec("ridge").fit(train.where(F.col("fold") != f), ["x"], "y")
        values.append(np.array([abs(r.y - r.yhat) for r in fitted.predict(train.where(F.col("fold") == f)).collect()]))
        for r in fitted.predict(test).dropDuplicates(["id"]).collect():
            heights.setdefault(r.id, []).append(r.yhat)
    assert {r.id for r in got} == set(heights) and len(got) == len(heights) == n // 2 + 1
    for r in got:
        low, high = (np.concatenate([h + s * v for h, v in zip(heights[r.id], values)]) for s in (-1, 1))
        assert np.allclose((r.low, r.high), (np.quantile(low, 0.1), np.quantile(high, 0.9)), atol=1e-9)


def test_cross_conformal_of_rows_without_all_predictions(spark):
    """A fold without residuals, and a test row that no model can predict, as before."""
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), i % 2) for i in range(40)], "id long, x double, y double, fold int")
    got = conformal.cross_conformal(df, df.where("id < 3").unionByName(df.where("id = 3").withColumn("x", F.lit(None).cast("double"))), Spec("ridge"), ["x"], "y", "id", 3)
    assert sorted(r.id for r in got.where("low < high").collect()) == [0, 1, 2] and got.count() == 3
    empty = conformal.cross_conformal(df.where("id < 0"), df.where("id < 3"), Spec("ridge"), ["x"], "y", "id", 3).collect()
    assert len(empty) == 3 and all(r.low is None for r in empty)


def test_ready_rows_are_written_once(spark):
    """each fit and prediction computed the features from lineitem anew."""
    from measura.plans.training import ready

    files = ready(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("/ready-" in f for f in files)


def test_weight_scan_fits_a_scaler_for_each_fold(spark, monkeypatch):
    """the scaler does not read the weights, but was fitted for each of them."""
    fitted, fit = [], prep.PowerScaler.fit
    monkeypatch.setattr(evaluate.PowerScaler, "fit", staticmethod(lambda train, columns: fitted.append(1) or fit(train, columns)))
    df = spark.createDataFrame([(i, float(i % 11), float(i % 11) * 2 + i % 3, i % 2) for i in range(60)], "id long, x double, y double, fold int").coalesce(1)
    other = df.withColumn("y", F.col("y") + 3)
    got = {r.model: r for r in evaluate.weight_scan(df, {"a": other, "b": other}, [0.0, 0.3, 0.6], ["x"], "y", 2, "id").collect()}
    assert len(fitted) == 4  # with the sources and without, for each fold
    for w in (0.0, 0.3, 0.6):
        one = evaluate.weighted_cv(df, [(other, w), (other, w)], Spec("ridge"), ["x"], "y", 2, "id")
        assert abs(metrics.fold_summary(one, "y", "yhat").first().r2_mean - got[f"w={w}"].r2_mean) < 1e-9
    tree = evaluate.weighted_cv(df, [(other, 0.3)], Spec("tree", {"maxDepth": 2}), ["x"], "y", 2, "id", scale=False)
    assert tree.count() == 60


def test_committee_reads_its_rows_few_times(spark):
    """medians and the scaler's grids each read the fold's rows through its components."""
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    df = spark.createDataFrame([(i, float(i % 11), float(i % 7), float(i % 5), i % 2, i // 2 % 2) for i in range(200)], "id long, x double, z double, y double, fold int, inner int")
    df = df.repartition(2).mapInPandas(count, df.schema)
    experts = {"a": (Spec("ridge"), ["x"]), "b": (Spec("ridge"), ["c0"])}
    got = evaluate.committee_cv(df, experts, "y", 2, "id", ["x"], {"c": (["x", "z"], 1)}, meta=Spec("ridge", {"alpha": 1.0}))
    assert got.count() == 200
    assert reads.value <= 9 * 200


def test_describe_reads_its_input_once(spark):
    """F16: the counts hold all that is asked for; groups without values have a row."""
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    v = [(None if i % 3 == 2 else float(i * 37 % 400), i % 3) for i in range(1200)]
    df = spark.createDataFrame(v, "v double, g int").repartition(2).mapInPandas(count, "v double, g int")
    got = {r.g: r for r in quality.describe(df, "v", ["g"]).collect()}
    assert reads.value == 1200
    for g in (0, 1):
        x = np.array([a for a, b in v if b == g])
        assert (got[g].n, got[g].low, got[g].high, got[g].distinct, got[g].median) == (len(x), x.min(), x.max(), len(set(x)), np.median(x))
        assert np.allclose((got[g]["mean"], got[g].deviation), (x.mean(), x.std()))
    assert got[2].n == got[2].distinct == 0 and got[2].low is got[2].deviation is got[2].median is None


def test_cross_conformal_of_ranges_of_one_value(spark):
    """height + value - height may be a little off the value, which then missed its own range."""
    rng = np.random.default_rng(1)
    values = [np.sort(np.abs(rng.normal(size=50))) for _ in range(3)]
    height = 500 + rng.normal(size=(200, 3))
    before = [np.arange(51)] * 3
    for place in (0, 14, 135, 149):
        every = np.sort(np.concatenate([v[None, :] + height[:, f:f + 1] for f, v in enumerate(values)], axis=1), axis=1)
        assert np.allclose(conformal._value_at(values, before, height, place), every[:, place], atol=1e-9)
    ends = pa.table({"fold": np.repeat(np.arange(3), 50), "low": np.concatenate(values), "high": np.concatenate(values), "n": np.ones(150, int)})
    cells = conformal._near(ends, 3, 150, [14.9, 134.1]).func(pd.Series(list(height)))
    for row, two in zip(height, cells):
        for (side, below, *at), (first, last) in zip(two, conformal._places(150, [14.9, 134.1])):
            assert below <= first and below + sum(b - a + 1 for a, b in zip(at[::2], at[1::2])) > last


def test_shadows_travel_in_pieces(spark, monkeypatch):
    """each value was a record of its own in two sorts by digest, a grouping and a join, in every round."""
    monkeypatch.setattr(select, "RANGE", 700, raising=False)  # several ranges, and tasks that deal more than once
    monkeypatch.setattr(select, "DEALT", 500, raising=False)
    n, features = 3000, ["a", "b"]
    rows = [(None if i == 5 else i, f"t{i}", float(i % 7), None if i % 11 == 0 else i * 3) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, name string, a double, b long").repartition(3).cache()
    df.count()
    before = shuffled_records(spark)
    got = {r.id: r for r in select.with_shadows(df, "id", features, 9).collect()}
    assert shuffled_records(spark) - before < n
    places = [sorted(rows, key=lambda r: hashlib.md5(":".join([head, *([] if r[0] is None else [str(r[0])])]).encode()).hexdigest()) for head in ("9", "9:shadow:0", "9:shadow:1")]
    assert len(got) == n
    for own, a, b in zip(*places):
        assert tuple(got[own[0]]) == (*own, a[2], None if b[3] is None else float(b[3]))
    assert select.with_shadows(df.where("id < 0"), "id", features, 9).count() == 0


def test_digests_are_counted_without_conversion(spark, monkeypatch):
    """each digest was converted to a number to be counted by range, in every round."""
    def no(*_):
        raise AssertionError("conversion")

    df = spark.range(900).select("id", (F.col("id") % 7).cast("double").alias("a"))
    alone = [tuple(r) for r in select.with_shadows(df, "id", ["a"], 3).collect()]  # one range
    monkeypatch.setattr(select.F, "conv", no)
    for most in (400, 40, 7):  # 4, 32 and 256 ranges
        monkeypatch.setattr(select, "RANGE", most)
        assert sorted(map(tuple, select.with_shadows(df, "id", ["a"], 3).collect())) == sorted(alone)


def test_shapley_values_are_looked_up_by_cell():
    """each row met all leaves of all trees."""
    rng = np.random.default_rng(2)
    tree = trees.Tree()
    for at in range(15):
        tree.split(at, int(rng.integers(0, 3)), float(rng.integers(-2, 3)))
    tree.value, tree.cover = rng.normal(size=31).tolist(), [1.0] * 31
    for at in range(14, -1, -1):
        tree.cover[at] = tree.cover[2 * at + 1] + tree.cover[2 * at + 2]
    x = rng.integers(-3, 4, size=(5000, 4)).astype(float)  # many values on thresholds
    few, many, lone = shapley.Leaves(tree), shapley.Leaves(tree), shapley.Leaves(trees.Tree())
    one, all_, none = np.zeros((5000, 4)), np.zeros((5000, 4)), np.zeros((5000, 4))
    for i in range(0, 5000, 10):
        few.seen, few.by_cell = 0, None
        few.add(x[i:i + 10], one[i:i + 10], 0.5)
    many.add(x, all_, 0.5)
    lone.add(x, none, 0.5)
    assert few.by_cell is None and many.by_cell is not None and len(many.by_cell) < 1000
    assert np.allclose(one, all_, atol=1e-12) and np.abs(all_).max() > 0 and not none.any()


def test_mixtures_are_summed_without_rows(spark, monkeypatch):
    """each pair and weight was a row, which scalers read for each power and forests kept. Folds and values may be missing, keys repeated."""
    monkeypatch.setattr(mixtures, "HELD", 30)  # several blocks
    monkeypatch.setattr(mixtures, "CELLS", 64)
    rng = np.random.default_rng(4)
    rows = [(i, float(x), 300.005 + 10 * float(x), i % 3 if i % 17 else None) for i, x in enumerate(rng.uniform(-0.9, 9, size=90).round(3))]
    rows += [(4, 1.0, 250.0, 0), (4, 2.0, 260.0, 1), (91, 2.5, -1.0, 0), (92, 2.5, None, 1), (93, None, 310.0, 2), (94, 3.0, 0.006, 1), (None, 1.0, 290.0, 1)]
    gold = spark.createDataFrame(rows, "k long, x double, y double, fold int").coalesce(1)
    weights = [0.1, 0.4, 0.9]  # not symmetric: the order of a pair counts
    pairs = joins.material_pairs(gold.where("k is not null"), "k", "y", ("x", "fold"))
    grid = joins.weight_grid(gold, "k", "y", weights, pairs=pairs)
    rows = grid.select("k1", "k2", "fold1", "fold2", (F.col("w1") * F.col("x1") + (1 - F.col("w1")) * F.col("x2")).alias("x"), F.col("mixed").alias("y")).cache()
    for scale in (False, True):
        want = {(r.model, r.fold, r.k, r.y): r.yhat for r in evaluate.leak_free_cv(gold, rows, Spec("ridge"), ["x"], "y", 3, "k", weight=0.1, scale=scale).collect()}
        before = shuffled_records(spark)
        got = evaluate.leak_free_mixtures(gold, weights, Spec("ridge"), "x", "y", 3, "k", weight=0.1, scale=scale).collect()
        assert scale or shuffled_records(spark) - before < 2_000 < rows.count()
        assert {(r.model, r.fold, r.k, r.y) for r in got} == set(want)
        assert all(abs(r.yhat - want[r.model, r.fold, r.k, r.y]) < 1e-6 for r in got if r.yhat is not None)
    cells = mixtures.Mixtures(gold, "k", "x", "y", weights, 3).by_cell()
    for f in range(3):
        free = rows.where(f"not (fold1 <=> {f}) and not (fold2 <=> {f}) and x is not null").toPandas()
        cuts, bins = cells.bins(f)
        at = np.searchsorted(cuts, free.x)
        assert np.allclose(bins, [np.bincount(at, v, bins.shape[1]) for v in (free.x * 0 + 1, free.y, free.y ** 2)])
        tree = mixtures.bagged_trees(bins * 1000, cuts, "x", 5, 1)  # many rows: a bag's means are those of all
        assert np.sqrt(np.mean((tree.values(free[["x"]].to_numpy()) - free.y) ** 2)) < free.y.std()


def test_cells_of_wide_ranges():
    """sums by cell stand for sums of any power, also where values are far apart, and on both sides of 0."""
    x = np.r_[np.random.default_rng(1).normal(size=500), 10.0 ** np.arange(-6, 7), -(10.0 ** np.arange(-6, 3)), 0.0]
    for part in (x, x[np.abs(x) < 5]):
        places = mixtures.Places(part.min(), part.max())
        assert (places.of_slot is None) == (len(part) == len(x))
        sums = places.sums(part, None)[:mixtures.ORDER + 1]
        for p in (-2.0, 0.0, 0.3, 1.0, 2.0, 2.4):
            z = places.series(p)
            want = mixtures.transformed(part, p)
            for got, of in ((z, want), (mixtures.multiplied(z, z), want ** 2)):
                assert abs((got * sums).sum() - of.sum()) < 1e-8 * np.abs(of).sum()


def test_hundredths_are_rounded_halves(spark):
    values = [0.005, 0.0049999, 1.005, 2.675, 123.455, 300.005, 345.995, 0.0, *(k / 1000 for k in range(300_000, 300_200))]
    want = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 2).alias("x")).collect()]
    assert np.array_equal(mixtures.hundredths(np.array(values)) / 100, want)


def test_pairs_are_sampled_without_rows(spark, monkeypatch):
    """each pair was a row with a digest of its own. Keys of several lengths, below 0, repeated and missing."""
    monkeypatch.setattr(mixtures, "HELD", 40)
    monkeypatch.setattr(splits, "AT_ONCE", 100)
    keys = [*range(95, 200), -7, 3, 10 ** 18, 120, 120, None]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").coalesce(1)
    every = sorted((hashlib.md5(f"42:{a}:{b}".encode()).hexdigest(), a, b) for a in keys[:-1] for b in keys[:-1] if a < b)
    before = shuffled_records(spark)
    got = splits.sample_of_all_pairs(rows, "k", 900, 9).collect()
    assert shuffled_records(spark) - before < 2_500 < len(every)
    assert sorted((r.k1, r.k2) for r in got) == sorted((a, b) for _, a, b in every[:100])
    monkeypatch.setattr(splits, "SPARE", 0)  # too few lie below the bound
    assert sorted((r.k1, r.k2) for r in splits.sample_of_all_pairs(rows, "k", 900, 9).collect()) == sorted((a, b) for _, a, b in every[:100])
    assert splits.sample_of_all_pairs(rows.limit(10), "k", 900, 9).count() == 45
