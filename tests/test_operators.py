"""Table operators on small rows with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from measura.functions import annotations, keys, mixing_rules, sequences
from measura.operators import joins, metrics, profiles, quality, resolve, splits


def meas(spark, rows):
    return spark.createDataFrame(rows, "key string, value double, source string, priority int, src_row int")


def test_median_conflict(spark):
    df = meas(spark, [("k", 300.0, "a", 0, 0), ("k", 400.0, "b", 1, 0), ("s", 5.0, "b", 1, 1)])
    got = {r.key: r for r in resolve.resolve_conflicts(df, ["priority", "src_row"]).collect()}
    assert got["k"].value == 350.0 and got["k"].source == "a+b" and got["k"].priority == 0
    assert got["s"].value == 5.0 and got["s"].source == "b"


def test_exclude_policy(spark):
    df = meas(spark, [("k", 300.0, "a", 0, 0), ("k", 600.0, "bad", 1, 0), ("k", 320.0, "c", 2, 0), ("o", 7.0, "bad", 1, 1), ("o", 9.0, "bad", 1, 2)])
    got = {r.key: r.value for r in resolve.resolve_conflicts(df, ["priority", "src_row"], "exclude", "bad").collect()}
    assert got == {"k": 310.0, "o": 8.0}
    first = {r.key: r.value for r in resolve.resolve_conflicts(df, ["priority", "src_row"], "first").collect()}
    assert first == {"k": 300.0, "o": 7.0}
    with pytest.raises(ValueError):
        resolve.resolve_conflicts(df, ["priority"], "mode")


def test_range_is_inclusive(spark):
    df = meas(spark, [("a", 100.0, "s", 0, 0), ("b", 900.0, "s", 0, 1), ("c", 99.9, "s", 0, 2), ("d", None, "s", 0, 3)])
    assert {r.key for r in resolve.in_range(df, 100, 900).collect()} == {"a", "b"}


def test_prefer_gold_keeps_null_keys(spark):
    gold, other = meas(spark, [("k", 1.0, "g", 0, 0)]), meas(spark, [("k", 2.0, "o", 1, 0), (None, 3.0, "o", 1, 1)])
    assert [r.key for r in resolve.prefer_gold(gold, other).collect()] == [None]
    assert resolve.unify(gold, other, ["priority", "src_row"]).count() == 2


def test_keys(spark):
    df = spark.createDataFrame([(" *C[*] ", "1.200"), ("C", "1.234"), (None, "x")], "k string, v string")
    got = df.select(keys.normalize_key(F.col("k")).alias("n"), keys.over_precise(F.col("v")).alias("p"), keys.has_marker(F.col("k")).alias("m")).collect()
    assert [(r.n, r.p, r.m) for r in got] == [("[*]C[*]", False, True), ("C", True, False), (None, False, False)]
    assert df.select(keys.to_kelvin(F.lit(100.0)).alias("t")).first().t == 373.15


def test_annotations(spark):
    df = spark.createDataFrame([("{A}|TG=373K;mn=50000;tg=1;bad|",), ("{B}",), ("|x=1|",)], "t string")
    m = df.select(annotations.properties(F.col("t")).alias("m"), annotations.base_of(F.col("t")).alias("b"), annotations.errors(F.col("t"), ["tg"]).alias("e")).collect()
    assert m[0].m == {"tg": "1", "mn": "50000"} and m[0].b == "{A}" and m[0].e == ["malformed_pair", "duplicate_key"]
    assert m[1].m == {} and m[1].b == "{B}" and m[1].e == []
    assert m[2].e == ["empty_base"]
    back = df.limit(1).select(annotations.render(annotations.base_of(F.col("t")), annotations.properties(F.col("t"))).alias("r")).first().r
    assert back == "{A}|mn=50000;tg=1|"


def test_sequences(spark):
    df = spark.createDataFrame([("5'-acg-3'",)], "s string").withColumn("c", sequences.clean(F.col("s")))
    assert df.first().c == "ACG"
    assert df.select(sequences.translate_sequence(F.col("c"), {"A": "a-", "C": "c-", "G": "g-"}, {"A": "a", "C": "c", "G": "g"}, True).alias("u")).first().u == "g-c-a"
    assert df.select(sequences.first_bad(F.lit("ACXG"), "ACG").alias("p")).first().p == 3


def test_mixing_rules(spark):
    one = spark.range(1)
    v = one.select(mixing_rules.virtual_value(F.lit(0.5), F.lit(300.0), F.lit(400.0), "F0").alias("a"), mixing_rules.virtual_value(F.lit(0.5), F.lit(-1.0), F.lit(400.0), "F0").alias("b"),
                   mixing_rules.softness(F.lit(10.0), F.lit(1.0)).alias("k")).first()
    assert v.a == round(1 / (0.5 / 300 + 0.5 / 400), 2) and v.b is None and v.k == 3.0
    with pytest.raises(ValueError):
        mixing_rules.virtual_value(F.lit(0.5), F.lit(1.0), F.lit(1.0), "F9")


def test_greedy_matches_against_a_loop(spark):
    import random

    random.seed(5)
    rows = [(e, m, random.sample(range(12), random.randint(1, 4))) for e in range(20) for m in range(random.randint(1, 6))]
    got = {r.entity: r for r in joins.greedy_matches(spark.createDataFrame(rows, "entity long, match long, members array<long>")).collect()}
    for e in range(20):
        claimed, taken = set(), []
        for _, m, x in sorted((-len(x), m, x) for a, m, x in rows if a == e):
            if not claimed & set(x):
                claimed |= set(x)
                taken.append(m)
        assert list(got[e].taken) == taken and got[e].claimed == len(claimed)


def test_leak_filter_keeps_no_test_parent(spark):
    folds = spark.range(10).select(F.col("id").alias("key"), (F.col("id") % 5).cast("int").alias("fold"))
    pairs = spark.range(10).alias("a").crossJoin(spark.range(10).alias("b")).select(F.col("a.id").alias("k1"), F.col("b.id").alias("k2")).where("k1 < k2")
    kept = joins.without_test_parents(pairs, folds, 5)
    assert all(r.k1 % 5 != r.fold and r.k2 % 5 != r.fold for r in kept.collect())
    assert kept.count() == sum(1 for a in range(10) for b in range(a + 1, 10) for f in range(5) if f not in (a % 5, b % 5))


def test_folds(spark):
    df = spark.range(50).withColumn("stratum", F.col("id") % 2)
    folds = splits.k_folds(df, "id", 5).groupBy("fold").count().collect()
    assert sorted((r.fold, r["count"]) for r in folds) == [(k, 10) for k in range(5)]
    assert sorted(r["count"] for r in splits.random_split(df, "id").groupBy("split").count().collect()) == [10, 40]
    assert sorted(r["count"] for r in splits.stratified_split(df, "id", "stratum").groupBy("stratum", "split").count().collect()) == [5, 5, 20, 20]
    odd = sorted(r["count"] for r in splits.k_folds(spark.range(52), "id", 5).groupBy("fold").count().collect())
    assert odd == [10, 10, 10, 10, 12]


def test_quantile_bins_keep_ties_together(spark):
    df = spark.createDataFrame([(float(v),) for v in [1] * 50 + list(range(2, 52))], "v double")
    bins = splits.quantile_bins(df, "v").groupBy("v").agg(F.count_distinct("bin").alias("n"))
    assert bins.where("n > 1").count() == 0


def test_metrics(spark):
    df = spark.createDataFrame([("m", 0, 1.0, 1.0), ("m", 0, 3.0, 2.0), ("m", 1, 5.0, 5.0), ("m", 1, 5.0, 6.0)], "model string, fold int, y double, yhat double")
    got = {r.fold: r for r in metrics.regression_metrics(df, "y", "yhat", ["model", "fold"]).collect()}
    assert got[0].mae == 0.5 and got[0].r2 == 0.5 and got[1].r2 == 0.0
    q = metrics.conformal_quantile(spark.createDataFrame([(float(i),) for i in range(1, 10)], "r double"), F.col("r"), 0.8).first()
    assert q.n == 9 and math.isclose(q.q, 1 + 8 * min(math.ceil(10 * 0.8) / 9, 1))


def test_profiles(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i), None if i % 2 else 1.0) for i in range(40)], "id long, y double, x double, z double")
    c = {r.feature: r for r in profiles.correlations(df, "id", "y", ["x", "z"]).collect()}
    assert math.isclose(c["x"].spearman, 1.0) and c["z"].n_valid == 20 and c["z"].pearson is None
    assert profiles.varying(df, ["x", "z"]) == ["x"]
    states = spark.createDataFrame([(1, 0.0)] * 6 + [(2, 0.0)] * 2, "entity long, energy double")
    s = {r.entity: r for r in profiles.effective_states(states).collect()}
    assert math.isclose(s[1].states_low, 6) and s[1].ratio == 1.0 and s[2].states_low is None
    line = spark.createDataFrame([(1, 0, k, float(k), 0.0, 0.0) for k in range(5)], "entity long, conf int, pos int, x double, y double, z double")
    p = profiles.path_statistics(line).first()
    assert p.contour == 4.0 and p.end_to_end == 4.0 and p.ratio == 1.0 and p.stiffness == 4.0


def test_quality(spark):
    df = meas(spark, [("a", 1.0, "s", 0, 0), ("a", 50.0, "t", 0, 1), ("b", 2.0, "s", 0, 2), (None, 3.0, "t", 0, 3)])
    o = quality.overlap_matrix(df).first()
    assert (o.a, o.b, o.shared, o.percent) == ("s", "t", 1, 100.0)
    assert quality.exclusive_keys(df).first().asDict() == {"source": "s", "exclusive": 1}
    assert quality.cross_source_conflicts(df).first().span == 49.0


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 4))
    df = spark.createDataFrame([(i, x[i].tolist(), float(i)) for i in range(80)], "id long, v array<double>, y double")
    asked = df.where("id % 10 = 0")
    got = {}
    for r in joins.nearest(df, asked, 3, "id", "v", "y", "id").orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.neighbour)
    for q, near in got.items():
        assert near == np.argsort(np.linalg.norm(x - x[q], axis=1), kind="stable")[:3].tolist()
    p = {r.query: r.yhat for r in joins.knn_predict(df, asked, 3, "id", "v", "y", "id").collect()}
    assert all(abs(p[q] - np.mean(n)) < 1e-9 for q, n in got.items())
    wide = df.withColumn("v", F.transform("v", lambda a, i: F.when(i == 0, a * 1000 + 7).otherwise(a)))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    for r in joins.knn_predict(wide, wide.where("id % 10 = 0"), 3, "id", "v", "y", "id", standardize=True).collect():
        assert abs(r.yhat - np.argsort(np.linalg.norm(z - z[r.query], axis=1), kind="stable")[:3].mean()) < 1e-9
    found = {(r.query, r.neighbour) for r in joins.nearest_lsh(df, asked, 3, "id", "v", "id", 4.0, 4.0, 12).collect()}
    want = {(q, n) for q, near in got.items() for n in near}
    assert len(found & want) >= 0.9 * len(want)


def test_ranks_against_a_sort(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), float(v) if v < 9 else None) for g, v in zip(rng.integers(0, 3, 400), rng.integers(0, 10, 400))]
    got = profiles.average_ranks(spark.createDataFrame(rows, "g int, v double"), "v", ["g"]).collect()
    for g in range(3):
        own = sorted(v for h, v in rows if h == g and v is not None)
        for r in (r for r in got if r.g == g):
            assert r.rank is None if r.v is None else r.rank == np.mean([k + 1 for k, v in enumerate(own) if v == r.v])


@pytest.mark.parametrize("policy", ["median", "exclude"])
def test_hot_keys_have_the_same_medians(spark, policy):
    rng = np.random.default_rng(8)
    rows = [(f"hot{k % 2}", float(np.round(v, 1)), "st"[int(v * 10) % 2], 0, k) for k, v in enumerate(rng.normal(50, 20, 5001))]
    rows += [("only", 1.0, "s", 0, k) for k in range(1500)] + [(f"cold{k % 400}", float(k), "st"[k % 3 > 0], 0, k) for k in range(900)] + [(None, 1.0, "s", 0, 0)]
    df = meas(spark, rows)
    hot = resolve.hot_keys(df, share=10)
    assert {r.key for r in hot.collect()} == {"hot0", "hot1", "only"}
    plain = resolve.resolve_conflicts(df, ["priority", "src_row"], policy, "s").orderBy("key").collect()
    assert resolve.resolve_conflicts(df, ["priority", "src_row"], policy, "s", hot=hot).orderBy("key").collect() == plain


def test_families_of_rows(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (20, "z")], "n int, u string"), spark.createDataFrame([(5, "p"), (9, "q")], "m int, v string")
    got = joins.generate_series([a, b], {"name": F.concat("u", "v"), "t": F.greatest(F.lit(320), 420 - 10 * F.col("n")), "half": F.expr("(n + m) div 2 + 10")})
    assert sorted((x.name, x.t, x.half) for x in got.collect()) == [("xp", 410, 13), ("xq", 410, 15), ("yp", 400, 13), ("yq", 400, 15), ("zp", 320, 22), ("zq", 320, 24)]
    assert joins.generate_series([a, b.limit(0)], {}).count() == 0


def test_profile_shows_first_rows(spark):
    df = spark.createDataFrame([(3, "7 K"), (1, "x"), (2, None)], "key int, value string")
    got = quality.profile_table(df, "value", first=2, order=["key"]).first()
    assert (got.n, got.parsed, list(got.first_rows)) == (3, 1, ['{"key":1,"value":"x"}', '{"key":2}'])


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev"])
@pytest.mark.parametrize("k", [1, 7])
def test_nearest_visits_few_cells(spark, metric, k):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 3)) * 20
    x = np.round(centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 3)), 1)
    x[:40] = x[0]  # many at one place
    q = np.r_[x[:30], rng.normal(size=(30, 3)) * 25]
    df = spark.createDataFrame([(i, list(map(float, v)), float(i)) for i, v in enumerate(x)], "id long, v array<double>, y double")
    asked = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(q)], "id long, v array<double>")
    cells = joins.Cells.fit(df, k, "id", "v", "y", metric, block=100)
    got = {}
    for r in cells.nearest(asked, "v", "id").collect():
        got.setdefault(r.query, []).append((r.distance, r.neighbour, r.rank))
    norm = {"euclidean": lambda d: np.sqrt((d ** 2).sum(axis=1)), "manhattan": lambda d: np.abs(d).sum(axis=1), "chebyshev": lambda d: np.abs(d).max(axis=1)}[metric]
    for i, v in enumerate(q):
        d = np.round(norm(x - v), 9)
        want = [(d[j], j, r + 1) for r, j in enumerate(np.lexsort((np.arange(1500), d))[:k])]
        assert sorted(got[i], key=lambda t: t[2]) == want
    compared = sum(int(cells.size[r.cell]) for r in cells.visits(asked, "v", "id").collect())
    assert compared < 0.5 * 1500 * 60


def test_nearest_of_few_rows(spark):
    df = spark.createDataFrame([(1, [0.0], 5.0), (2, [1.0], None), (3, None, 1.0)], "id long, v array<double>, y double")
    got = joins.nearest(df, df, 4, "id", "v", "y", "id").orderBy("query", "rank").collect()
    assert [(r.query, r.neighbour, r.label) for r in got] == [(1, 1, 5.0), (1, 2, None), (2, 2, None), (2, 1, 5.0)]
    assert joins.nearest(df.limit(0), df, 4, "id", "v", "y", "id").count() == 0
    assert joins.nearest(df, df.limit(0), 4, "id", "v", "y", "id").count() == 0


@pytest.mark.parametrize("parts", [1, 9])
def test_places_by_range(spark, parts):
    from measura.operators import ranks

    rng = np.random.default_rng(2)
    rows = [(None if g == 2 else int(g), float(v), int(w)) for g, v, w in zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500), rng.integers(1, 5, 500))]
    df = spark.createDataFrame(rows, "g int, v double, w int").repartition(parts)
    got = ranks.placed(df, ["v"], "at", ["g"]).collect()
    for g in (None, 0, 1):
        own = sorted((r.at, r.v) for r in got if r.g == g)
        assert [a for a, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for h, v, _ in rows if h == g)
    heavy = ranks.placed(df, ["v", "w"], "at", ["g"], "w").collect()
    for g in (None, 0, 1):
        own = sorted((r.at, r.w) for r in heavy if r.g == g)
        assert [a for a, _ in own] == np.cumsum([0, *(w for _, w in own[:-1])]).tolist()
    asked = spark.createDataFrame([(g, float(v), s) for g in (0, 1) for v in (-1, 3, 7, 99) for s in (True, False)], "g int, v double, s boolean")
    for r in ranks.counts_upto(df.select("g", "v"), asked, ["g"], "v", "s", "n").collect():
        assert r.n == sum(h == r.g and (v < r.v if r.s else v <= r.v) for h, v, _ in rows)


def test_hot_keys_are_found(spark):
    """A key with most rows: the default finds it, and its median is exact."""
    rows = [("hot" if i % 3 else f"k{i % 50}", float(i * 7919 % 5000), "ab"[i % 2], i) for i in range(6000)]
    df = spark.createDataFrame(rows, "key string, value double, source string, o int")
    assert [r.key for r in resolve.hot_keys(df).collect()] == ["hot"]
    plain = {r.key: (r.value, r.source, r.o) for r in resolve.resolve_conflicts(df, ["o"], hot=None).collect()}
    assert {r.key: (r.value, r.source, r.o) for r in resolve.resolve_conflicts(df, ["o"]).collect()} == plain
    assert plain["hot"][0] == np.median([v for k, v, _, _ in rows if k == "hot"])


def test_quantiles_read_their_input_once(spark):
    from measura.operators.quantiles import quantiles

    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    df = spark.range(1000).select(F.col("id").cast("double").alias("v")).repartition(2).mapInPandas(count, "v double")
    assert quantiles(df, "v", [0.25, 0.5]).first()["__q"] == [249.75, 499.5]
    assert reads.value == 1000


def test_pairs_of_one_file_are_dealt_over_many_tasks(spark, monkeypatch):
    """a table of one file gave all its pairs to one task; all pairs come once, whichever side is held."""
    m = spark.range(301).select(F.col("id").alias("k"), (300 + F.col("id") * 0.37).alias("t"), (F.col("id") % 5).alias("fold")).coalesce(1)
    want = {(a, b) for a in range(301) for b in range(a + 1, 301)}
    monkeypatch.setattr(joins, "PAIRS_OF_TASK", 10_000)
    for held, tasks in ((1000, 10), (10, 4)):
        monkeypatch.setattr(joins, "MOST_HELD", held)
        pairs = joins.material_pairs(m, "k", "t", ("fold",))
        assert pairs.rdd.getNumPartitions() >= tasks
        got = [(r.k1, r.k2) for r in pairs.collect()]
        assert len(got) == len(want) and set(got) == want and pairs.where("fold1 <> k1 % 5 or fold2 <> k2 % 5").count() == 0
    grid = joins.weight_grid(m, "k", "t", [0.1, 0.5])
    assert grid.count() == 2 * len(want) and grid.where("mixed is null or mixed <> round(1 / (w1 / v1 + (1 - w1) / v2), 2)").count() == 0


def test_leaks_are_counted_without_pairs(spark):
    """the same counts as from the pairs, with keys given twice, without key and without fold."""
    rows = [(k, 1.0, k % 3 if k != 7 else None) for k in [*range(20), 4, 4, 9]] + [(None, 1.0, 1)]
    m = spark.createDataFrame(rows, "k long, t double, fold int")
    pairs = joins.material_pairs(m, "k", "t", ("fold",)).drop("fold1", "fold2")
    want = joins.without_test_parents(pairs, m.where("k is not null").select(F.col("k").alias("key"), "fold").distinct(), 4).groupBy("fold").count()
    got = {r.fold: r.n for r in joins.leak_counts(m, "k", "fold", 4).collect()}
    assert got == {r.fold: r["count"] for r in want.collect()} and set(got) == {0, 1, 2, 3}
    assert "NestedLoop" not in joins.leak_counts(m, "k", "fold", 4)._jdf.queryExecution().toString()
    assert joins.leak_counts(m.where("k = 1"), "k", "fold", 4).count() == 0


def test_cheap_rounding_is_rounding(spark):
    """halves, large, missing and odd values come out as of ``round``."""
    values = [0.005, 0.0049999, 1.005, 2.675, 1e15 + 0.3, -0.004, -1.005, 0.0, 123.455, 1e300, float("nan"), float("inf"), None, *(k / 997 for k in range(2000)), *(k / 1000 for k in range(2000))]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert df.where(~mixing_rules.rounded(F.col("x"), 2).eqNullSafe(F.round("x", 2)) | ~mixing_rules.rounded(F.col("x"), 6).eqNullSafe(F.round("x", 6))).count() == 0


def test_sampled_pairs_are_the_first_by_digest(spark, monkeypatch):
    """only digests below a bound are sorted; all of them where too few lie below."""
    pairs = joins.material_pairs(spark.range(200).select(F.col("id").alias("k"), F.lit(1.0).alias("t")), "k", "t")
    want = [(r.k1, r.k2) for r in pairs.orderBy(splits.digest(42, "k1", "k2")).limit(100).collect()]
    assert {(r.k1, r.k2) for r in splits.sample_pairs(pairs, "k1", "k2", 900, 9).collect()} == set(want)
    monkeypatch.setattr(splits, "SPARE", 0)
    assert {(r.k1, r.k2) for r in splits.sample_pairs(pairs, "k1", "k2", 900, 9).collect()} == set(want)


def test_few_units_are_held_by_every_task(spark, monkeypatch):
    """the rows of each symbol met in one task."""
    units = spark.createDataFrame([("A", "a-", "a"), ("C", "c-", "c")], "symbol string, inner string, last string")
    df = spark.createDataFrame([(1, "AACX"), (2, "CA")], "id long, seq string")
    want = {(1, 0, "a-"), (1, 1, "a-"), (1, 2, "c-"), (2, 0, "c-"), (2, 1, "a")}
    for most in (10, 1):
        monkeypatch.setattr(sequences, "MOST_UNITS", most)
        got = sequences.expand(df, "id", "seq", units)
        assert {(r.id, r.position, r.unit) for r in got.collect()} == want
        assert ("SortMergeJoin" in got._jdf.queryExecution().sparkPlan().toString()) == (most == 1)


def test_paths_are_dealt_once(spark, tmp_path, monkeypatch):
    """windows and groups of an entity's rows need one shuffle, into tasks that grow with the rows."""
    from measura.plans import views

    rows = [(o, p, 1, n, float(o + n), float(p), 0.01 * n, 0.02, "A" if n % 2 else "N") for o in range(40) for p, n in enumerate(range(5))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(views, "DEALT", 20)
    plain, dealt = (profiles.path_statistics(views.view(spark, str(tmp_path), views.COORDS, d)) for d in (None, {"lineitem": "l_orderkey"}))
    assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in dealt.collect()} and dealt.count() == 40
    others = [p.count("Exchange ") - p.count("REPARTITION_BY_NUM") for p in (df._jdf.queryExecution().executedPlan().toString() for df in (plain, dealt))]
    assert others[1] == 0 < others[0] and dealt.rdd.getNumPartitions() == 10


def test_fingerprint_positions(spark, tmp_path):
    """positions come from the sparse vector; its zeros are not made."""
    from pyspark.ml.functions import vector_to_array

    from measura.plans import QUERIES

    spark.createDataFrame([(1, "abcabcdef"), (2, ""), (3, None), (4, "ab")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["f12_hashed_ngrams"](spark, str(tmp_path))
    dense = sequences.hashed_ngrams(spark.read.parquet(f"{tmp_path}/documents.parquet"), "text", "b").select("doc_id", vector_to_array("b").alias("b")).collect()
    assert {r.doc_id: r.bits for r in got.collect()} == {r.doc_id: [i for i, x in enumerate(r.b) if x > 0] for r in dense}
    assert "vector_to_array" not in got._jdf.queryExecution().toString()
