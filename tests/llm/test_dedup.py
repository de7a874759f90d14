"""Exact and near duplicates against brute force, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from measura.llm import components as cc
from measura.llm import exact_dedup as ed
from measura.llm import simhash as sh

SCHEMA = "doc_id long, text string, i long, t string, __i long, row string"


def frame(spark, rows):
    return spark.createDataFrame([(a, b, 1, "x", 7, None) for a, b in rows], SCHEMA)


ROWS = [(5, "a  b"), (3, "a b"), (3, "a b"), (9, None), (8, ""), (None, "a\tb"), (None, "only here"), (None, "only here"), (1, "x" * 300_000), (2, "x" * 300_000), (7, " a b")]


def normal(t):
    return re.sub("[ \t-\r]+", " ", t or "")


def check_exact(got, rows):
    big = ed.LAST
    groups = {}
    for a, b in rows:
        groups.setdefault(normal(b), []).append(a if a is not None else big)
    assert len(got) == len(rows)
    kept = {}
    for r in got:
        g = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(g) and r.keep_id == (min(g) if min(g) < big else None)
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) <= {1} and len(kept) == len(groups)


def test_exact(spark):
    got = ed.exact_dedup(frame(spark, ROWS)).collect()
    check_exact(got, ROWS)
    assert ed.exact_dedup(frame(spark, []), "doc_id").count() == 0


def test_exact_hot_groups(spark):
    rows = [(i, "hot text" if i % 3 else f"text {i % 40}") for i in range(600)]
    check_exact(ed.exact_dedup(frame(spark, rows), salts=5).collect(), rows)


def test_exact_compares_content_when_digests_collide(spark):
    rows = ROWS + [(i, f"t{i % 7}") for i in range(100, 140)]
    check_exact(ed.exact_dedup(frame(spark, rows), digest=lambda t: F.lit(b"same")).collect(), rows)


def test_drop_copies(spark):
    kept = ed.drop_copies(frame(spark, ROWS))
    assert kept.columns == ["doc_id", "text", "i", "t", "__i", "row"]
    rows = kept.collect()
    assert sorted(normal(r.text)[:20] for r in rows) == sorted({normal(b)[:20] for _, b in ROWS}) and all(r["__i"] == 7 for r in rows)


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "A b", "a b c", "a b c d e f a b c", "É É x y ÉA", "w " * 70_000])
def test_fingerprint(text):
    assert sh.fingerprint(text) == plain_fingerprint(text)


def brute(prints, radius=3):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    u = sorted(set(prints))
    for i, a in enumerate(u):
        for b in u[i + 1:]:
            if bin(a ^ b).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in u}


def families(seed, n=30, each=25):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        p = r.getrandbits(64)
        for _ in range(each):
            out.append(p)
            for _ in range(r.randint(1, 4)):
                p ^= 1 << r.randrange(64)
    return out


@pytest.mark.parametrize("chunk", [4, 2048])
def test_links_find_every_component(spark, chunk):
    """A small chunk sends large buckets through pairs of chunks."""
    prints = families(chunk) + [p & ~0xFFF for p in families(3, 1, 60)]
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in sorted(set(prints))], "fp long")
    links = sh.near_links(nodes, chunk=chunk)
    assert links.count() < 12 * len(set(prints))
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in cc.components(links).collect()}
    want = brute(prints)
    same = {}
    for p, w in want.items():
        same.setdefault(w, set()).add(got.get(p, p))
    assert all(len(v) == 1 for v in same.values()) and len({v.copy().pop() for v in same.values()}) == len(same)


def test_pivot_tables_never_lose_a_link():
    u = np.array(families(9, 10, 20), np.uint64)
    d = sh.distances(u).astype(int)
    for i in range(len(u)):
        near = np.bitwise_count(u ^ u[i]) <= 3
        assert (np.abs(d - d[i]).max(axis=1)[near] <= 3).all()


def test_components_of_a_long_chain(spark):
    got = cc.components(spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).collect()
    assert len(got) == 201 and len({r.root for r in got}) == 1


def test_simhash_rows(spark):
    base = " ".join(f"w{k}" for k in range(400))
    rows = [(4, base), (2, base + " more"), (9, None), (6, ""), (6, ""), (None, base), (1, "something else entirely here"), (None, "a lonely text without id"), (3, base.upper())]
    got = sh.simhash_components(frame(spark, rows)).collect()
    prints = {r: plain_fingerprint(t) for r, (_, t) in enumerate(rows)}
    roots = brute(list(prints.values()))
    for r, (i, t) in enumerate(rows):
        mine = [x for x in got if x.doc_id == i and int(x.fingerprint, 16) == prints[r]]
        ids = [a for k, (a, _) in enumerate(rows) if roots[prints[k]] == roots[prints[r]] and a is not None]
        assert mine and all(x.component_id == (min(ids) if ids else None) for x in mine)
    kept = sh.drop_near_copies(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "i", "t", "__i", "row"] and kept.count() == len(set(roots.values()))
    assert sh.simhash_components(frame(spark, [])).count() == 0 and sh.drop_near_copies(frame(spark, [])).count() == 0
