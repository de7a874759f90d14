"""What training takes from the driver (pipeline: it was stopped at 1,500 MB of driver memory in the mixing stage)."""

import os

import numpy as np
from pyspark.sql.classic.dataframe import DataFrame

from measura.llm import mixing, toxicity


def test_toxicity_is_trained_in_a_task(spark, monkeypatch):
    """The driver's Python trained and kept about 95 MB of that for all later stages."""
    def where(sentences):
        return toxicity.Machine(np.full(toxicity.SYMBOLS ** 3, float(len(sentences))), float(os.getpid()), 4.0, 0.0, 0.8, 5)

    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "train", where)
    got = toxicity.fit(docs, labels)
    assert got.bias != os.getpid() and len(got.weights) == toxicity.SYMBOLS ** 3 and got.span == 5
    used = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").count()
    assert set(got.weights) == {float(used)}  # all of the sample in the one task
    assert toxicity.fit(docs, labels.limit(0)) is None and toxicity.fit(docs.limit(0), labels) is None
    monkeypatch.setattr(toxicity, "train", lambda sentences: None)
    assert toxicity.fit(docs, labels) is None


def test_steps_of_the_rates_stand_once_in_a_plan(spark, monkeypatch):
    """Each domain's sum held all gradient steps again, so plans grew with domains times steps times domains."""
    plans, first = [], DataFrame.first

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction("))
        return first(df)

    monkeypatch.setattr(DataFrame, "first", seen)
    names = ["a", "b", "c", "d"]
    rows = [([.7, .1, .1, .1], 50), ([.1, .6, .2, .1], 30), ([.2, .2, .5, .1], 20), ([.1, .1, .1, .7], 10)]
    scored = spark.createDataFrame(rows, "__p array<double>, __n int")
    model = mixing.Domains(names, [[]] * 4, [0.0] * 4, [[0.0] * 4] * 4)
    found = mixing.fit_rates(scored, model, {"a": .3, "b": .3, "c": .2, "d": .2}, tolerance=4e-3)
    assert len(found.steps) > 1 and max(plans) == min(p for p in plans if p)  # as many as one rate has, not one by domain
    r = np.ones(4)
    p, n = np.array([x for x, _ in rows]), np.array([x for _, x in rows])
    for step in found.steps:
        r = np.maximum(found.least, r - p @ np.array(step))
    assert np.allclose((r * n) @ p, found.reached)
    assert max(plans) <= 8
