"""Registered queries read their whole input: small tables of their own, no test tables needed."""

import random

import numpy as np
import pytest

from measura.operators import evaluate
from measura.plans import QUERIES
from measura.plans import training


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root, r = str(tmp_path_factory.mktemp("whole")), random.Random(1)
    spark.createDataFrame([(1, "abc" * 500 + "xyz"), (2, "abc"), (3, None)], "doc_id long, text string").selectExpr("*", "'s' AS source", "'en' AS lang").write.parquet(f"{root}/documents.parquet")
    # Dimensions from 16 on vary most, so that the first component is made of them.
    spark.createDataFrame([(i, [r.gauss(0, 1) * (10 if d == 40 else 1) for d in range(64)]) for i in range(200)], "vec_id long, embedding array<double>").write.parquet(f"{root}/embeddings.parquet")
    spark.createDataFrame([(i, 10.0 * i) for i in range(30)], "s_suppkey long, s_acctbal double").write.parquet(f"{root}/supplier.parquet")
    return root


def test_fingerprints_of_whole_texts(spark, folder):
    got = {x.doc_id: x.bits for x in QUERIES["f12_hashed_ngrams"](spark, folder).collect()}
    assert got[3] == [] and len(got[2]) == 1 and set(got[2]) < set(got[1])
    assert 4 <= len(got[1]) <= 6 and all(0 <= b < 1024 for b in got[1])  # abc, bca, cab, cxy, xyz and bcx


def test_components_of_all_dimensions(spark, folder):
    rows = {x.vec_id: x.embedding for x in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    got = {x.vec_id: x.pc0 for x in QUERIES["m17_pca"](spark, folder).collect()}
    both = [i for i in rows if got[i] is not None]
    assert np.corrcoef([abs(rows[i][40]) for i in both], [got[i] for i in both])[0, 1] > 0.9


def test_leak_free_validation_has_all_pairs(spark, folder):
    _, virtual = training._virtual(spark, folder)
    assert virtual.count() == 5 * 30 * 29 // 2 and virtual.select("k1", "k2").distinct().count() == 30 * 29 // 2


def test_keys_of_whole_texts(spark, folder):
    got = {x.doc_id: x.norm for x in QUERIES["p01_normalize_key"](spark, folder).collect()}
    assert got[1] == "abc" * 500 + "xyz" and got[3] is None


def test_virtual_values_of_all_pairs(spark, folder):
    assert QUERIES["f03_virtual_values"](spark, folder).count() == 30 * 29 // 2


def test_weight_scan_tests_every_gold_row(spark, folder, monkeypatch):
    """folds are id % 3, but two were tested: a third of the gold rows never was."""
    spark.createDataFrame([(i, 1 + i * 7 % 50, 900.0 + i) for i in range(60)], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(i % 60, float(1 + i * 11 % 50), i % 10 / 100) for i in range(300)], "l_partkey long, l_quantity double, l_discount double").write.parquet(f"{folder}/lineitem.parquet")
    tested, summary = [], evaluate.fold_summary
    monkeypatch.setattr(evaluate, "fold_summary", lambda df, *a: tested.extend((r.model, r.id) for r in df.collect()) or summary(df, *a))
    QUERIES["m07_weight_scan"](spark, folder)
    assert sorted(tested) == [(f"w={w}", i) for w in (0.2, 0.8) for i in range(0, 60, 2)]
