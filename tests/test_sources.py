"""Files, specs, stores, and work that resumes."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measura.functions import keys
from measura.operators.featurize import featurize, incremental_apply, skipped
from measura.sources import Column_, SourceSpec, conform, load_all, materialize_once, read_delimited, resolve_column, write_report
from measura.streaming.incremental import append_new


def test_read_delimited(spark, tmp_path):
    (tmp_path / "bom.csv").write_bytes("﻿PSMILES,Tg_K\n*CC*,300\n,1\n".encode())
    df = read_delimited(spark, str(tmp_path / "bom.csv"))
    assert df.columns == ["PSMILES", "Tg_K"] and df.count() == 2
    (tmp_path / "latin.tsv").write_bytes("name\tv\nBl\xe4tter\t1\n".encode("latin-1"))
    assert read_delimited(spark, str(tmp_path / "latin.tsv"), "\t").first().name == "Bl\xe4tter"
    missing = read_delimited(spark, str(tmp_path / "none.csv"), columns=["a", "b"])
    assert missing.columns == ["a", "b"] and missing.count() == 0


SPEC = SourceSpec("a", 0, {"key": Column_(("PSMILES", "SMILES"), required=True, convert=keys.normalize_key), "value": Column_(("Tg_K",), "double", required=True),
                           "name": Column_(("polymer_name",)), "ratio": Column_(("ratio",), "double", default=100.0)}, {"reliability": "high"})


def test_conform(spark):
    raw = spark.createDataFrame([("*CC*", "300.5", " "), (" ", "1", "x"), ("CC", "bad", "y"), ("[*]O", "20", "z")], "SMILES string, Tg_K string, polymer_name string")
    got = {r.key: r for r in conform(raw, SPEC).collect()}
    assert set(got) == {"[*]CC[*]", "[*]O"}
    r = got["[*]CC[*]"]
    assert (r.value, r.name, r.ratio, r.reliability, r.source, r.priority) == (300.5, None, 100.0, "high", "a", 0)


def test_load_all(spark):
    raw = spark.createDataFrame([("x", "100"), ("y", "900"), ("z", "950"), ("w", "50")], "SMILES string, Tg_K string")
    specs = [SPEC, SourceSpec("b", 1, SPEC.columns), SourceSpec("poor", 2, SPEC.columns)]
    tables = dict.fromkeys(("a", "b", "poor"), raw)
    got = load_all(tables, specs, low=100, high=900, leave_out=("poor",))
    assert sorted((r.source, r.key) for r in got.collect()) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]
    assert {r.source for r in load_all(tables, specs, names=["b", "unknown"]).collect()} == {"b"}
    with pytest.raises(ValueError):
        load_all(tables, specs, names=["unknown"])


def test_resolve_column(spark):
    df = spark.createDataFrame([(1, 2)], ["My_SMILES", "Tg (K)"])
    assert resolve_column(df, "smiles") == "My_SMILES" and resolve_column(df, "tg") == "Tg (K)" and resolve_column(df, "no") is None


def test_materialize_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert materialize_once(spark, make, f"file://{tmp_path}", "spec", "v1").count() == 3
    materialize_once(spark, make, f"file://{tmp_path}", "spec", "v2")
    assert len(calls) == 2


def test_incremental_apply(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType())])
    seen = []

    def fn(df):
        seen.append(df.count())
        return df.select("id", F.when(F.col("id") != 2, F.col("id") * 2.0).alias("v"))

    path = f"file://{tmp_path}/done"
    assert incremental_apply(spark, spark.range(4), "id", path, fn, schema).count() == 3
    assert incremental_apply(spark, spark.range(6), "id", path, fn, schema).count() == 5
    assert seen == [4, 2]


def test_featurize(spark):
    def vector(k):
        if k == "bad":
            raise ValueError("no")
        return [float(len(k)), 1.0]

    df = featurize(spark.createDataFrame([("ab",), ("bad",)], "k string"), "k", ["n", "one"], vector)
    got = {r.k: r for r in df.collect()}
    assert got["ab"].n == 2.0 and got["bad"].n is None and "no" in got["bad"].error
    assert skipped(df).first().skipped == 1


def test_report(spark, tmp_path):
    df = spark.range(2).select("id", F.struct(F.lit(None).cast("double").alias("x")).alias("s"))
    write_report(df, str(tmp_path / "r"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "r")).count() == 2
    with pytest.raises(ValueError):
        write_report(df, str(tmp_path / "q"), "xml")


def test_append_new(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    spark.range(3).write.parquet(src)
    schema = T.StructType([T.StructField("id", T.LongType())])
    append_new(spark, src, schema, out, ck, lambda df: df, "id")
    spark.range(2, 5).write.mode("append").parquet(src)
    append_new(spark, src, schema, out, ck, lambda df: df, "id")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]
