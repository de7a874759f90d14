"""Registered queries against their SQL on small tables, where the tables are at hand."""

import os

import pytest

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from measura.plans import ORACLES, QUERIES

    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")

    def plain(rows, names):
        return sorted((tuple(round(r[k] + 0.0, 9) if isinstance(r[k], float) else r[k] for k in names) for r in rows), key=repr)

    wrong = []
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, DIR)
        rel = c.sql(sql)
        names = sorted(df.columns)
        if names != sorted(rel.columns) or plain(df.collect(), names) != plain([dict(zip(rel.columns, r)) for r in rel.fetchall()], names):
            wrong.append(name)
    assert not wrong


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
