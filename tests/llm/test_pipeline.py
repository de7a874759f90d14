"""Every stage of the corpus pipeline against brute force on its own input."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as cp
from measura.llm import toxicity
from measura.llm.queries import tokenizer_path
from measura.llm.simhash import fingerprint

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs.collect()]
    for name, stage in cp.STAGES:
        stage(spark, docs, DIR).write.parquet(f"file://{root}/{name}")
        docs = spark.read.parquet(f"file://{root}/{name}")
        out.append(docs.collect())
    return out


def test_columns(spark, outputs):
    want = spark.read.parquet(f"{DIR}/documents.parquet").columns
    assert all(r.asDict().keys() == set(want) for rows in outputs[1:5] for r in rows[:3])


def test_toxicity(spark, outputs):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    machine = toxicity.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    kept = set()
    for r in outputs[0]:
        margin = toxicity.document_margins(pa.array([r.text], pa.string()), machine) if machine else np.array([-np.inf])
        if machine is None or not np.isfinite(margin[0]) or machine.probability(margin)[0] < .5:
            kept.add(r.doc_id)
    assert {r.doc_id for r in outputs[1]} == kept


def test_exact(outputs):
    first = {}
    for r in sorted(outputs[1], key=lambda r: r.doc_id):
        first.setdefault(re.sub("[ \t-\r]+", " ", r.text or ""), r.doc_id)
    assert sorted(r.doc_id for r in outputs[2]) == sorted(first.values())


def test_near(outputs):
    ids = sorted((r.doc_id, fingerprint(r.text)) for r in outputs[2])
    group = {i: i for i, _ in ids}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for k, (i, p) in enumerate(ids):
        for j, q in ids[k + 1:]:
            if bin(p ^ q).count("1") <= 3:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    assert sorted(r.doc_id for r in outputs[3]) == sorted({find(i) for i, _ in ids})


def test_mixing_keeps_and_repeats(outputs):
    before, after = Counter(r.doc_id for r in outputs[3]), Counter(r.doc_id for r in outputs[4])
    assert set(before) == set(after) and all(after[i] >= before[i] for i in before)
    text = {r.doc_id: r.text for r in outputs[3]}
    assert all(r.text == text[r.doc_id] for r in outputs[4])


def test_packing(outputs):
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for r in outputs[4]:
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        for p, s in enumerate(range(0, len(ids), 2048)):
            want[r.doc_id, p, s, zlib.crc32(ids[s:s + 2048].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in outputs[5]) == want
    size = Counter()
    for r in outputs[5]:
        size[r.sequence_id] += r.length
    assert max(size.values()) <= 2048


def test_registered_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from measura.llm import queries as q

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    for name, sql in q.oracle_sql().items():
        df = q.queries()[name](spark, DIR)
        rel = c.sql(sql)
        assert sorted(rel.columns) == sorted(df.columns)
        want = sorted(tuple(dict(zip(rel.columns, r))[k] for k in df.columns) for r in rel.fetchall())
        assert sorted(tuple(r) for r in df.collect()) == want


ODD = [(1, "the thing and the other was here for all of us to read today", "en", "s", 3), (1, "the thing and the other was here for all of us to read today", "en", "s", 3), (None, "no id at all but words that nobody else has written down", None, None, None),
       (2, None, "en", "s", None), (3, "", None, None, 0), (4, "the  thing and\tthe other was here for all of us to read today", "de", None, 3), (5, "w " * 30_000, "en", "s", 60_000), (6, "!!! ###", "en", "s", 7)]
WIDE = "doc_id long, text string, lang string, source string, n_chars long, score double, __i string, c0 int, seq string"


def odd_tables(spark, path, rows, labels):
    spark.createDataFrame([(*r, 0.5, "i", 1, "s") for r in rows], WIDE).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, None, None), (None, 1, 1), (5, 0, 0), (99, 1, 1)]])
def test_stages_meet_odd_rows(spark, tmp_path, labels):
    """Nulls in any column, empty and long texts, rows given twice, extra columns whose names clash, missing labels."""
    at = odd_tables(spark, tmp_path, ODD, labels)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, at)
        if name != "packing":
            assert out.columns == docs.columns, name
        out.write.parquet(f"file://{tmp_path}/out{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/out{k}")
        if name == "exact_dedup":
            assert sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.collect()) == [-1, 1, 2, 5, 6]  # texts 3 and 4 are copies, row 1 came twice
    assert {r.doc_id for r in docs.collect()} >= {1, 5, None}


def test_the_pipeline_of_nothing(spark, tmp_path):
    assert cp.run(spark, odd_tables(spark, tmp_path, [], [])).count() == 0
