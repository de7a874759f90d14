"""Filter audit, Merkle manifest and decontamination against brute force, with odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from measura.llm import decontaminate as dc
from measura.llm import filter_audit as fa
from measura.llm import merkle as mk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, g string, mask int, w string, tree string, pos string"


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source), with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", "y", 7, "z", "t", None) for r in rows], SCHEMA)


# --- op11

LONG = " ".join(f"w{i}" for i in range(250))
AUDIT = [(1, LONG, "en", "s"), (2, LONG, "en", "s"), (3, LONG + " #", "en", "s"), (4, None, "en", "s"), (5, "", "de", None), (6, "A B C D", None, ""), (7, "a " * 400, "en", "s"),
         (7, "a " * 400, "en", "s"), (None, LONG, "en", "s"), (8, "ÄÖ É x", "fr", "t"), (9, LONG.upper(), "en", "s"), (10, LONG.upper(), "en", "t"), (11, "x$" * 200_000, "en", "t"), (None, "alone", "en", "t")]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (7, 1, 1), (7, 0, 0), (10, 1, None), (None, 1, 1), (99, 1, 1)]


def plain_mask(text, first):
    t = text or ""
    w = [x for x in re.split("[ \t-\r]+", t) if x]
    return (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), not first)


def plain_audit(rows, labels):
    last = 1 << 63
    first, cells = {}, []
    for i, t, *_ in rows:
        first[t or ""] = min(first.get(t or "", last), last - 1 if i is None else i)
    for i, t, _, s in rows:
        fails = plain_mask(t, (last - 1 if i is None else i) == first[t or ""])
        good = any(q == 1 for d, q, _ in labels if d is not None and d == i)
        toxic = any(x == 1 for d, _, x in labels if d is not None and d == i)
        cells.append((s or "", {c for c, f in zip("ABCDE", fails) if f}, good, toxic))
    out, shapley = {}, {}
    for part in {c[0] for c in cells}:
        own = [c[1:] for c in cells if c[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [c for c in left if letter in c[0]]
                failing = [c for c in own if letter in c[0]]
                left = [c for c in left if letter not in c[0]]
                out[part, order, step] = (len(left), len(gone), len(failing) - len(gone), sum(c[0] == {letter} for c in own), sum(c[1] for c in gone), sum(c[2] for c in gone))
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = fa.filter_audit(docs(spark, AUDIT), labels).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = plain_audit(AUDIT, LABELS)
    assert len(got) == len(want) == 600 * len({r[3] or "" for r in AUDIT})
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got} == want


def test_filter_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.filter_audit(docs(spark, []), labels).count() == 0
    assert fa.filter_audit(docs(spark, AUDIT[:3]), labels).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_filter_audit_with_other_filters(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = fa.filter_audit(docs(spark, AUDIT), labels, {"X": F.length("text") > 5}).collect()
    assert {(r.filter_order, r.step) for r in got} == {(o, s) for o in ("XE", "EX") for s in (1, 2)}
    with pytest.raises(ValueError):
        fa.filter_audit(docs(spark, AUDIT), labels, {"E": F.lit(True)})


def test_recursion_has_no_row_limit(spark):
    """More rows than the recursion's default limit allows, as many parts give."""
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        cells = spark.range(40).select(F.concat(F.lit("p"), "id").alias("part"), F.expr("array(named_struct('mask', 3, 'n', 2L, 'good', 1L, 'toxic', 0L))").alias("cells"))
        assert fa.prefixes(cells, "ABC").count() == 40 * 15
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "100"
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)


# --- op12


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k:k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def plain_siblings(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at // 8 * 8
        out.append((nodes[first:at], nodes[at + 1:first + 8]))
        at //= 8
    return out


def plain_manifest(rows):
    def leaf(i, t, lang, source, n):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, t)))

    per = {}
    for i, t, lang, source in rows:
        n = None if t is None else len(t)
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        low = t if t is None else t.encode().lower().decode()
        own = leaf(i, t, lang, source, n)
        per.setdefault(lang, []).append((-1 if i is None else i, own, i, leaf(i, low, lang, source, n) if hit else own))
    order = sorted(per, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: plain_tree([x[1] for x in sorted(per[lang])]) for lang in order}
    top = plain_tree([trees[lang][-1][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for at, (_, own, i, start) in enumerate(sorted(per[lang])):
            path = plain_siblings(trees[lang], at) + plain_siblings(top, k)
            node = start
            for a, z in path:
                node = h(*a, node, *z)
            out.append((i, own, trees[lang][-1][0], top[-1][0], h(*("".join(a + z) for a, z in path)), node, node == top[-1][0]))
    return sorted(out, key=str)


MERKLE = [(5, "Abc É", "en", "s"), (3, None, "en", None), (3, "x", None, "s"), (None, "B", "en", "s"), (9, "", "de", ""), (9, "", "de", ""), (7, "Q" * 300_000, "é", "s"), (8, "q", "z", "s"), (-1, "K", "", "s")]


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_manifest(spark, block, monkeypatch):
    monkeypatch.setattr(mk, "DEPTH", {8: 1, 64: 2, 4096: 4}[block])
    monkeypatch.setattr(mk, "BLOCK", block)
    rng = random.Random(4)
    rows = MERKLE + [(rng.randrange(10**6), f"Text {k}", rng.choice(["en", "en", "fr", None]), "s") for k in range(700)] + [(k, "T", f"l{k}", "s") for k in range(70)]
    got = mk.manifest(docs(spark, rows).repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_manifest_of_few_rows(spark, n):
    rows = [(k, f"T{k}", "en", "s") for k in range(n)]
    got = mk.manifest(docs(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_manifest(rows)
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 3 != 0) for r in got)


def test_manifest_of_nothing(spark):
    assert mk.manifest(docs(spark, [])).count() == 0


def test_versions_share_untouched_nodes():
    block = mk.Block([h(str(k)) for k in range(500)], 500)
    before = [list(x) for x in block.levels]
    path = block.version(77, h("other"))
    assert block.levels == before and len(path) == len(block.levels)
    leaves = block.levels[0].copy()
    leaves[77] = h("other")
    changed = mk.Block(leaves, 500)
    assert path == [changed.levels[k][77 // 8 ** k] for k in range(len(path))]
    assert sum(a != b for x, y in zip(block.levels, changed.levels) for a, b in zip(x, y)) == len(path)


# --- op13


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())


def plain_hits(rows, items):
    wins = {}
    for i, t in items:
        w = plain_words(t)
        if i is not None and w:
            for k in range(max(len(w) - 9, 1)):
                wins.setdefault(tuple(w[k:k + 10]), set()).add(i)
    out = []
    for i, t, *_ in rows:
        w, hit, found = plain_words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[k:k + n]))):
                    hit |= set(range(k, k + n))
                    found |= own
        names = sorted(map(str, found))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit), names))
    return sorted(out, key=str)


def item_frame(spark, items):
    return spark.createDataFrame([(i, t, 1, "w") for i, t in items], "item_id long, text string, pos int, word string")


PHRASE = "the quick brown fox jumps over the lazy dog again and again"
ITEMS = [(1, PHRASE), (2, "to be or not to be to be or not to be"), (3, "a a a a a a a a a a"), (4, "Short One"), (5, None), (6, "  ..."), (None, "zzz"), (7, PHRASE), (10, "één Ünder"), (1, PHRASE), (8, "never there at all")]
PLAIN = [(1, "x " + PHRASE.upper() + "!! y", "en", "s"), (2, "so: to be, or not; to be? to be or not to be to be or", "en", "s"), (3, "a " * 25, "en", "s"), (4, None, "en", "s"), (5, "", "en", "s"),
         (5, "short one and short,one", "en", "s"), (None, "nothing short here one", "en", "s"), (6, "één ünder één Ünder", "en", "s"), (7, " ".join(PHRASE.split()[:9]), "en", "s"),
         (8, "w " * 60_000 + PHRASE, "en", "s"), (9, PHRASE, "en", "s"), (9, PHRASE, "en", "s"), (11, "zzz", "en", "s"), (12, "A b İI", "en", "s")]


def test_decontamination(spark):
    got = dc.decontaminate(docs(spark, PLAIN), item_frame(spark, ITEMS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_hits(PLAIN, ITEMS)


def test_decontamination_of_random_texts(spark):
    rng = random.Random(8)
    vocab = [f"v{k}" for k in range(6)] + ["Ä"]
    rows = [(k, " ".join(rng.choices(vocab, [5, 3, 1, 1, 1, 1, 1], k=rng.randrange(0, 120))), "en", "s") for k in range(120)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randrange(0, 9)))) for k in range(60)] + [(100 + k, " ".join(rows[k][1].split()[5:30])) for k in range(8)]
    want = plain_hits(rows, items)
    assert sum(x[5] for x in want) > 20
    assert sorted((tuple(r) for r in dc.decontaminate(docs(spark, rows), item_frame(spark, items)).collect()), key=str) == want


def test_decontamination_beyond_the_broadcast_bound(spark, monkeypatch):
    """Words, lists and windows by shuffle instead of broadcast give the same."""
    meet = dc.meet
    monkeypatch.setattr(dc, "meet", lambda tokens, listed, on, most=0: meet(tokens, listed, on, 0))
    monkeypatch.setattr(dc, "checked_broadcast", lambda df, most=0: df)
    got = dc.decontaminate(docs(spark, PLAIN), item_frame(spark, ITEMS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_hits(PLAIN, ITEMS)


def test_decontamination_of_nothing(spark):
    none = dc.decontaminate(docs(spark, PLAIN), item_frame(spark, [])).collect()
    assert len(none) == len(PLAIN) and not any(r.contaminated or r.n_hit or r.n_items for r in none)
    assert dc.decontaminate(docs(spark, []), item_frame(spark, ITEMS)).count() == 0


def test_near_matches(spark):
    """Each word of the phrase up to ``slop`` words from its place beside the rarest word."""
    rng = random.Random(5)
    base = "alpha beta gamma delta epsilon".split()
    rows = [(k, " ".join(rng.choices([*base, "x", "y"], k=40)), "en", "s") for k in range(60)]
    rows += [(100, "alpha x beta gamma delta epsilon", "en", "s"), (101, "alpha beta x y z x y z gamma delta epsilon", "en", "s"), (102, " ".join(base), "en", "s")]
    found, _ = dc.windows_of(item_frame(spark, [(1, " ".join(base))]), 5)
    frame = docs(spark, rows)
    postings, counts = dc.build_index(frame, found)
    lists = dc.lists_of(found, counts)
    order = [x.o for x in lists.first().lists]
    for slop in (0, 1, 3):
        got = {(r.d, r.at) for r in dc.matches(postings, lists, slop).collect()}
        want = set()
        for i, t, *_ in rows:
            w = t.split()
            for p in (p for p, x in enumerate(w) if x == base[order[0]]):
                at = p - order[0]
                if all(any(abs(q - at - o) <= slop and w[q] == base[o] for q in range(len(w))) for o in order[1:]) and (slop or at >= 0):
                    want.add((i, at))
        assert got == want
    exact = {r.d for r in dc.matches(postings, lists).collect()}
    assert 102 in exact and 100 not in exact


def test_index_runs_without_python_workers(spark):
    found, _ = dc.windows_of(item_frame(spark, ITEMS))
    postings = docs(spark, PLAIN).select(*dc._keys("doc_id", "text"), F.posexplode(dc.words(F.col("text"))).alias("pos", "word"))
    plan = postings._jdf.queryExecution().toString() + found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
