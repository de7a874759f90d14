"""Packing, toxicity, language, personal data, HTML, WARC and mixing on small texts."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from measura.llm import html_text, language, mixing, packing, pii, search, toxicity, warc
from measura.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, i long, t string, score double, lang string"


def frame(spark, rows, lang=None):
    return spark.createDataFrame([(a, b, 1, "x", 0.5, (lang or {}).get(a)) for a, b in rows], SCHEMA)


WORDS = "the thing ther ouble ation erly and reon sted inger with lyre thand oner".split()


def text(seed, n=40, extra=()):
    r = random.Random(seed)
    w = [r.choice(WORDS) + r.choice(["", "ing", "er"]) for _ in range(n)]
    for x in extra:
        w.insert(r.randrange(n), x)
    return " ".join(w)


# Packing.

@pytest.mark.parametrize("seed", range(6))
def test_plan_is_whole(seed):
    r = random.Random(seed)
    count = Counter(r.randint(1, 60) if seed % 2 else int(min(60, r.lognormvariate(2.5, 1) + 1)) for _ in range(r.randint(1, 400)))
    runs = packing.plan(count, 60)
    bins, used = defaultdict(list), Counter()
    for length, rank, n, seq, offset in sorted(runs):
        assert rank == used[length]
        used[length] += n
        for k in range(n):
            bins[seq + k].append((offset, length))
    assert used == count
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 60
    assert len(bins) <= 1 + 1.05 * sum(k * v for k, v in count.items()) / 60 + sum(v for k, v in count.items() if k > 30)


def least_bins(items, cap):
    best = len(items)

    def go(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(items):
            best = len(free)
            return
        for j in {f: j for j, f in enumerate(free) if f >= items[k]}.values():
            free[j] -= items[k]
            go(k + 1, free)
            free[j] += items[k]
        go(k + 1, [*free, cap - items[k]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_fixed_sets_cost_no_sequence(seed):
    r = random.Random(seed)
    items = sorted((r.randint(2, 20) for _ in range(9)), reverse=True)
    fixed, left = packing.reduce_dominated(Counter(items), 20)
    rest = sorted(left.elements(), reverse=True)
    assert sum(t for _, t in fixed) + least_bins(rest, 20) == least_bins(items, 20)


def test_reduction_depends_on_lengths_not_pieces():
    import time

    r = random.Random(1)
    began = time.process_time()
    for many in (Counter({k: r.randint(1, 20_000) for k in range(1024, 2049)}), Counter({k: r.randint(1, 10_000) for k in range(1, 2049)}), Counter({1500: 5_000_000, 500: 5_000_000})):
        runs = packing.plan(many, 2048)
        assert sum(n for _, _, n, _, _ in runs) == many.total() >= 10_000_000
    assert time.process_time() - began < 10


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(tokenizer_path()), packing._Tokens(tokenizer_path())
    r = random.Random(3)
    parts = list("abzABZ'sd09é ßÉİΣς <|>_-!?.,\t\n½ª漢😀́") + ["<|endoftext|>", "'s", "don't", " word ", "Ünd"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(800)] + [None, "", "x" * 50_000]
    for x, got in zip(texts, own(pa.array(texts))):
        assert got.tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_packed_rows(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = [(1, text(1)), (2, None), (2, None), (3, ""), (4, text(2, 900)), (None, text(3)), (5, text(1))]
    got = packing.pack_documents(frame(spark, rows), tokenizer_path(), capacity=64).collect()
    want = Counter()
    for i, x in rows:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        for p, s in enumerate(range(0, len(ids), 64)):
            want[i, p, s, len(ids[s:s + 64]), zlib.crc32(ids[s:s + 64].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for v in places.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 64
    assert packing.pack_documents(frame(spark, []), tokenizer_path()).count() == 0


# Toxicity.

def test_subsequence_kernel_against_brute_force():
    from itertools import combinations

    def features(w, decay=0.8, span=5):
        w = f"`{w}`"
        out = Counter()
        for c in combinations(range(len(w)), 3):
            if c[2] - c[0] < span:
                out["".join(w[k] for k in c)] += decay ** (c[2] - c[0] + 1)
        n = sum(v * v for v in out.values()) ** .5
        return {k: v / n for k, v in out.items()}

    words = ["idiot", "idxiot", "aa", "thing", "ouble"]
    k = toxicity.kernel(words, words, 0.8, 5)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = features(a), features(b)
            assert abs(k[i, j] - sum(v * y.get(f, 0) for f, v in x.items())) < 1e-5


@pytest.fixture(scope="module")
def labelled():
    bad = ["idiot", "moron", "scum", "worthless"]
    return [(i, text(i, 40, [bad[i % 4]] if i % 4 == 3 or i % 9 == 0 else []), int(i % 4 == 3 or i % 9 == 0)) for i in range(600)]


def test_toxicity_held_out(spark, labelled):
    docs = frame(spark, [(i, t) for i, t, _ in labelled] + [(10_000, None), (10_001, ""), (10_002, "... 123"), (10_003, text(7, 30_000)), (10_004, "you i-d-i-o-t you"), (10_005, "such an i d i o t here"), (None, "idiot"), (None, "idiot")])
    labels = spark.createDataFrame([(i, y) for i, _, y in labelled] + [(None, 1), (5, None)], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    got = toxicity.score_toxicity(docs, machine).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    held = [i for i, _, _ in labelled if by[i].held_out]
    assert held and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held)
    assert np.mean([by[i].predicted == y for i, _, y in labelled if by[i].held_out]) > 0.97
    assert [by[k].predicted for k in range(10_000, 10_006)] == [0, 0, 0, 0, 1, 1]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= .5) for r in got) and len(got) == docs.count()
    clean = toxicity.drop_toxic(docs, machine)
    assert clean.columns == docs.columns and clean.count() == sum(not r.predicted for r in got)


def test_toxicity_training_bounds(monkeypatch):
    import inspect

    assert [inspect.signature(toxicity.fit).parameters[k].default for k in ("most_toxic", "most_clean")] == [2_000, 5_000]
    rows = []
    monkeypatch.setattr(toxicity, "_svm", lambda z, y, *_: (rows.append(int((y < 0).sum())), (np.zeros(z.shape[1]), 0.))[1])
    names = ["".join("abcdefghijklmnopqrstuvwxyz"[n // 26 ** k % 26] for k in range(4)) for n in range(25_000)]
    for n, want in ((18_000, 18_000), (25_000, 20_000)):
        rows.clear()
        toxicity.train([(0, names[a:a + 100]) for a in range(0, n, 100)] + [(1, ["idiotic", "aaaa"])] * 40)
        assert rows[0] == want  # clean tokens used as negatives


def test_svm_blocks_equal_one_solve():
    r = np.random.default_rng(0)
    z, y = r.normal(size=(5_000, 8)), np.where(r.random(5_000) < .3, 1., -1.)
    z[:, 0] += y
    weight = r.random(5_000) + .1
    w, b = toxicity._svm(z, y, weight, .003)
    x = np.hstack([z, np.ones((5_000, 1))])
    v = np.append(w, b)
    gradient = v * np.append(np.full(8, .003), 1e-8) - x.T @ (weight * y * np.maximum(0, 1 - y * (x @ v)))
    assert np.abs(gradient).max() < 1e-2 * np.abs(x.T @ (weight * y)).max()


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "idiot"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, none) is None
    assert {r.score for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), None).count() == 0


# Language.

def test_presence_kernel_against_brute_force():
    texts = [b"The cat", b"a  cat!", "Straße é".encode(), b""]
    model = language.train([("a", "the cat sat"), ("a", "a cat is here"), ("b", "die straße ist"), ("b", "das ist gut"), ("b", "é und ß")])

    def grams(t):
        c = language._byte_classes()[np.frombuffer(b" " + t + b"   ", np.uint8)]
        own = len(t) + 2
        return {(n, *c[k:k + n]) if k + 1 < own or n < 3 else (n, 0, 0, 0) for k in range(own) for n in (1, 2, 3)}

    b = model.presence(texts)
    for i, t in enumerate(texts):
        known = {(n + 1, code) for n, col in enumerate(model.columns) for code in np.flatnonzero(col < len(model.landmarks[0]))}
        mine = {(g[0], int(sum(x * language.CLASSES ** (g[0] - 1 - k) for k, x in enumerate(g[1:])))) for g in grams(t)}
        assert b[i].sum() == len(mine & known)


def test_language_held_out(spark):
    sets = {"en": "the and of that with from this have".split(), "de": "der die und nicht sich auf eine über".split(), "fr": "le des les pour une dans été où".split()}
    r = random.Random(1)
    rows, lang = [], {}
    for i in range(400):
        lang[i] = r.choice(list(sets))
        rows.append((i, " ".join(r.choice(sets[lang[i]]) for _ in range(r.randint(3, 30)))))
    docs = frame(spark, [*rows, (900, None), (901, "123 !!"), (902, ""), (903, "x " * 100_000), (None, "der die und"), (None, "der die und")], lang)
    got = {r.doc_id: r for r in language.identify_language(docs, language.fit(docs)).collect()}
    held = [i for i in range(400) if got[i].held_out]
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held) and np.mean([got[i].lang_pred == lang[i] for i in held]) > 0.95
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0 and got[None].lang_pred == "de"
    assert language.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in language.identify_language(docs, None).collect()} == {"und"}


# Personal data.

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_emails_equal_the_pattern():
    r = random.Random(2)
    for _ in range(5000):
        s = "".join(r.choice("ab.@-% +1\n") for _ in range(30))
        assert pii.emails(s) == [m.span() for m in EMAIL.finditer(s)]


@pytest.mark.parametrize(("source", "kind", "part"), [
    ("write john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("bob at example dot com, ok", "email", "bob at example dot com"),
    ("to joe＠example．com", "email", "joe＠example．com"),
    ("mail jо@exаmple.com is", "email", "jо@exаmple.com"),
    ("ring plus one five five five one two three four five six seven now", "phone", "plus one five five five one two three four five six seven"),
    ("call ＋１ ９８８ ５５５ ２４８５ x", "phone", "＋１ ９８８ ５５５ ２４８５"),
    ("card 4O41894974608795 x", "card", "4O41894974608795"),
    ("at 192[.]168[.]1[.]1 it", "ip", "192[.]168[.]1[.]1"),
])
def test_disguises(source, kind, part):
    found = pii.hidden(source, pii.find(source))
    a = source.index(part)
    assert found[kind] == [(a, a + len(part))]


def test_plain_text_has_no_disguises():
    for s in ["he was at home. The dot of it, three of two", "seven of nine at one", "(at) the [dot]", "look at example of that", "a" * 100_000]:
        assert not any(pii.hidden(s, pii.find(s)).values())


@pytest.mark.parametrize(("source", "kind", "part"), [
    ("Call +49 one six one 5550123 now", "phone", "+49 one six one 5550123"),
    ("or +1 555 one two 34567, ok", "phone", "+1 555 one two 34567"),
    ("or +1 555 12 three 4567, ok", "phone", "+1 555 12 three 4567"),
    ("ring plus 49 161 555 0123, ok", "phone", "plus 49 161 555 0123"),
    ("card 4000 one one one one 0000 0014 x", "card", "4000 one one one one 0000 0014"),
    ("card 4OO0000000000002 x", "card", "4OO0000000000002"),
])
def test_mixed_numerals_and_words(source, kind, part):
    a = source.index(part)
    new, first, last, made = pii.rewrite(source, 0, len(source))
    whole = [(first[s], last[e]) for s, e in ((s, e - 1) for s, e in pii.find(new)[kind]) if any(made[s:e + 1])]
    assert whole == [(a, a + len(part))]
    for text in (source, source + " five", "x " * 300 + source):
        shift = text.index(source)
        assert pii.hidden(text, pii.find(text))[kind] == [(x + shift, y + shift) for x, y in whole]


def test_letters_that_only_match_number_words():
    assert not any(pii.hidden("+1 ſix one 2", pii.find("+1 ſix one 2")).values())


def test_html_beyond_four_hundred_open_elements():
    body = "The cat and the dog were in the house and that is what they had to say about it to us all."
    page = "<article>" + "<div>" * 500 + f"<p>{body}</p><nav>Home and away</nav><div>" + "<div></div>" * 20 + f"<p>{body}</p></article><p>Foot</p>"
    found = {b.text: b for b in html_text.blocks(page)}
    assert found["Home and away"].outside and found[body].article and not found["Foot"].article
    assert [b.article for b in html_text.blocks(page)] == [True, True, True, False]


PATTERNS = {
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda x: all(int(p) <= 255 for p in x.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda x: 14 <= len(re.sub(r"\D", "", x)) <= 19 and pii.luhn(re.sub(r"\D", "", x))),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda x: 10 <= len(re.sub(r"\D", "", x)) <= 15),
    "email": (EMAIL, lambda x: True),
}


def test_base_spans_equal_the_patterns(spark):
    r = random.Random(7)
    alphabets = ["0123456789", "0123456789. ", "01+() .-", "9.9.25", "a@b.c-+1 2", "4111 1111 1111 1111-+. a@b.de"]
    texts = ["".join(r.choice(r.choice(alphabets)) for _ in range(r.randint(0, 60))) for _ in range(3_000)]
    texts += ["".join(r.choice(a) for _ in range(r.randint(0, 80))) for a in alphabets for _ in range(1_500)]
    want = {}
    for k, x in enumerate(texts):
        spans = {kind: [m.span() for m in p.finditer(x) if ok(m.group())] for kind, (p, ok) in PATTERNS.items()}
        assert pii.find(x) == {kind: spans[kind] for kind in pii.KINDS}, x
        rows = sorted((a, pii.KINDS.index(kind), b) for kind in spans for a, b in spans[kind])
        want[k] = (*(len(spans[kind]) for kind in pii.KINDS), hashlib.sha256(",".join(f"{pii.KINDS[i]}:{a}:{b}" for a, i, b in rows).encode()).hexdigest())
    got = pii.find_personal_data(frame(spark, list(enumerate(texts)))).collect()
    assert {x.doc_id: (x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) for x in got} == want


@pytest.mark.parametrize("text", ["1" * 1_000_000, "1." * 500_000, "1 " * 500_000, "1.2.3 " * 160_000, "+1" * 500_000, "+1 " + "1" * 900_000 + "a", "+1(" * 330_000, "a@" * 500_000, "a." * 500_000 + "@", "one " * 250_000, "O1" * 500_000])
def test_long_texts_take_linear_time(text):
    import time

    began = time.process_time()
    pii.hidden(text, pii.find(text))
    assert time.process_time() - began < 20
    if text.strip("1") == "":
        assert time.process_time() - began < 2


def test_personal_data_rows(spark):
    t = "😀 a@b.co, 10.0.0.1 and 300.1.1.1; 4041894974608795 +1 (988) 555-2485 jo [at] b [dot] co"
    got = {r.doc_id: r for r in pii.find_personal_data(frame(spark, [(1, t), (2, None), (3, ""), (None, t)])).collect()}
    r = got[1]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_disguised) == (1, 1, 1, 1, 1)
    base = ",".join(f"{k}:{t.index(x)}:{t.index(x) + len(x)}" for k, x in (("email", "a@b.co"), ("ip", "10.0.0.1"), ("card", "4041894974608795"), ("phone", "+1 (988) 555-2485")))
    assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans == f"{base},email:{t.index('jo [')}:{len(t)}"
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[None].spans == r.spans
    assert pii.find_personal_data(frame(spark, [])).count() == 0


# HTML.

PAGE = """<html><head><title>T</title><script>if (a < b) "</p>"</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=1>Home</a></ul></nav>
<div class="cookie-notice">We use cookies for all of the things that you do.</div><div id=content><h2>Big &amp; small</h2>
<p>This is the text of the article, and it is a long one with many of the words that you would have in it.<p>Short  one.
<p>More of the text that was in the article, and it is what they had for all of us to see.</p></div><aside>Ad of the day is here for you to see and to have.</aside>
<section id="comments"><p>I am the reader and this is what I think of it all, if you ask me.</p></section><footer>&copy; 2024</footer>"""


def test_main_text(spark):
    want = "Big & small\nThis is the text of the article, and it is a long one with many of the words that you would have in it.\nShort one.\nMore of the text that was in the article, and it is what they had for all of us to see."
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", "<article><p>x <b>y<br>z</article> <p", 1), (4, "u", "plain", 1), (5, "u", "<div>" * 3000 + "deep", 1)], "page_id long, url string, html string, u int")
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract_text(pages).collect()]
    assert got[0] == (1, want, len(want)) and got[1] == (2, "", 0) and got[2] == (3, "", 0)
    assert got[3][1].startswith("x y z") and got[4] == (4, "plain", 5) and got[5][1] == "deep"
    assert html_text.extract_text(pages.limit(0)).count() == 0


BODY = "The cat and the dog were in the house and that is what they had to say about it to us all."
ARTICLE = f"<p>{BODY}</p>" * 3
WHOLE = "\n".join([BODY] * 3)


@pytest.mark.parametrize(("page", "want"), [
    (f'<body class="single comments-open"><article>{ARTICLE}</article>', WHOLE),
    (f'<article data-comment-count="3">{ARTICLE}</article>', WHOLE),
    (f'<article class="commentary">{ARTICLE}</article>', WHOLE),
    (f'<div class="post-content has-sidebar">{ARTICLE}</div>', WHOLE),
    (f'<article><div class="entry share-enabled">{ARTICLE}</div></article>', WHOLE),
    (f'<div class="content-sidebar-wrap">{ARTICLE}<div class="sidebar">{ARTICLE}</div></div>', WHOLE),
    (f"<form>{ARTICLE}</form>", WHOLE),
    (f'<div class="overflow-hidden">{ARTICLE}</div>', WHOLE),
    (f'<article>{ARTICLE}</article><article class="comment">{ARTICLE}</article>', WHOLE),
    (f'<div>{ARTICLE}</div><section id="comments"><div class="sidebar">{ARTICLE * 9}</div></section>', WHOLE),
    (f'<article>{ARTICLE}<figure><figcaption>Cap</figcaption></figure><p>a <math>x</math> b<object>c</object></article>', f"{WHOLE}\nCap\na x bc"),
    (f'<article>{ARTICLE}<p>Text <span class="ad">Buy <span>it</span> now</span> more<li class="share">Share<li>Kept</article>', f"{WHOLE}\nText more\nKept"),
    (f'<article><h1 class="header">Title</h1>{ARTICLE}</article>', f"Title\n{WHOLE}"),
    (f'<article><p hidden>gone</p><p style="display: none">gone</p>{ARTICLE}</article>', WHOLE),
])
def test_articles_are_kept(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("page", ['<li class="share">x</li>' * 40_000, "<p>" + '<span class="ad">x' * 60_000, '<div class="sidebar">' * 50_000 + BODY, '<p class="ad">x<div>' * 50_000,
                                  '<a "' * 250_000, "<a '\">\"" * 140_000, "<" * 1_000_000, "<div>" * 5_000 + BODY * 2_000])
def test_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 5


def plain_labels(rows):
    """Both passes over (text, linked, outside, article, heading), block by block."""
    first = []
    for text, linked, outside, article, heading in rows:
        words = re.findall(r"[a-z]+", text.lower())
        rich = len(text) > 60 and sum(w in html_text.STOP for w in words) >= 0.18 * len(words)
        if outside or linked > 0.35 * len(text) and not heading and not (article and rich):
            first.append(0)
        elif article or rich:
            first.append(1)
        else:
            first.append(0 if len(text) > 60 and linked > 0.15 * len(text) else None)
    use = [k for k, v in enumerate(first) if v is not None and not rows[k][2]] or [k for k, v in enumerate(first) if v is not None]
    out = []
    for k, v in enumerate(first):
        up, down = max((j for j in use if j < k), default=None), min((j for j in use if j > k), default=None)
        if v is not None:
            out.append(v)
        elif up is None or down is None:
            out.append(1 if up is down else first[down if up is None else up])
        elif first[up] == first[down] or rows[k][4]:
            out.append(first[down])
        else:
            a, z = (sum(len(r[0]) for r in rows[x + 1:y]) for x, y in ((up, k), (k, down)))
            out.append(first[up] if a < z else first[down] if z < a else int(any(w in html_text.STOP for w in rows[k][0].split())))
    return out


def test_labels_equal_brute_force():
    r = random.Random(5)
    texts = [BODY, "cat dog", "the one", "zebra " * 20, "alpha beta", "of all the things " * 5]
    for _ in range(400):
        rows = []
        for _ in range(r.randint(1, 9)):
            t = r.choice(texts).strip()
            rows.append((t, r.choice([0, 0, len(t) // 4, len(t)]), r.random() < .2, r.random() < .2, r.random() < .2))
        found = [html_text.Block(*x) for x in rows]
        html_text.label_blocks(found)
        assert [b.label for b in found] == plain_labels(rows), rows


# WARC.

def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/é", PAGE, 1), (2, None, None, 1), (3, "http://b", "", 1), (3, "http://b", "", 1), (None, "x", "<p>t", 1)], "page_id long, url string, html string, row int")
    responses = warc.responses_of(pages)
    for r in responses.collect():
        assert r.payload_digest == warc.digest(r.payload.encode())
    records = warc.derive(responses)
    rows = records.collect()
    assert Counter(r.warc_type for r in rows) == {"metadata": 5, "conversion": 5}
    ids = {r.record_id for r in responses.collect()}
    assert all(r.refers_to in ids and r.block_digest == warc.digest(r.block.encode()) and r.content_length == len(r.block.encode()) for r in rows)
    one = next(r for r in rows if r.response_row == 1 and r.warc_type == "metadata")
    assert "source-http-header: Content-Type: text/html; charset=utf-8" in one.block and "title: T\r\n" in one.block and "outlink: 1\r\n" in one.block
    warc.write_warc(records, f"file://{tmp_path}/w")
    back = warc.read_warc(spark, f"file://{tmp_path}/w/*.gz").collect()
    assert Counter((r.headers["warc-record-id"], bytes(r.block)) for r in back) == Counter((r.record_id, r.block.encode()) for r in rows)
    assert warc.derive(responses.limit(0)).count() == 0


# Mixing.

def test_rates_meet_targets(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        d = i % 3
        p = rng.dirichlet(np.where(np.arange(3) == d, 20., 1.))
        rows.append((int(rng.integers(1, 50)), p.tolist()))
    model = mixing.Domains(["a", "b", "c"], [[], [], []], [0.] * 3, [[0.] * 3] * 3)
    scored = spark.createDataFrame(rows, "__n int, __p array<double>")
    n, p = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for total in (None, 0.8):
        m = mixing.fit_rates(scored, model, {"a": .5, "b": .3}, total, tolerance=4e-3)
        r, least = np.ones(300), 1.0 if total is None else 0.0
        for c in m.steps:
            r = np.maximum(least, r - p @ np.array(c))
        assert np.allclose((r * n) @ p, m.reached) and (r >= least).all()
        got = scored.select(mixing.rate(F.col("__p"), m.steps, m.least).alias("r")).toPandas().r.to_numpy()
        assert np.allclose(got, r)
        if total:
            assert np.allclose(m.reached, m.targets, rtol=2e-2) and np.isclose(sum(m.targets), .8 * n.sum())


def test_rates_equal_an_independent_solver(spark):
    """Least squares over nonnegative weights, r = 1 + w, against an active-set search over distinct posteriors, and the conditions of an optimum."""
    rng = np.random.default_rng(3)
    kinds = rng.dirichlet([.6, .5, .4], 12)
    which = rng.integers(0, 12, 400)
    n, p = rng.integers(1, 60, 400), kinds[which]
    model = mixing.Domains(["a", "b", "c"], [[], [], []], [0.] * 3, [[0.] * 3] * 3)
    scored = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "__n int, __p array<double>")
    have = n @ p
    for shares in ({"a": .5, "b": .3}, {"a": .2, "b": .2}):
        m = mixing.fit_rates(scored, model, shares, tolerance=4e-3)
        r = np.ones(400)
        for c in m.steps:
            r = np.maximum(1, r - p @ np.array(c))
        loss = float((((n * r) @ p - m.targets) ** 2 / (2 * have)).sum())
        words = np.bincount(which, weights=n, minlength=12)
        w = np.ones(12)  # one rate for each posterior: coordinate descent to the end
        for _ in range(2_000):
            for k in range(12):
                gap = ((words * w) @ kinds - m.targets) / have
                w[k] = max(1, w[k] - (kinds[k] @ gap) / (words[k] * (kinds[k] ** 2 / have).sum())) if words[k] else 1
        least = float((((words * w) @ kinds - m.targets) ** 2 / (2 * have)).sum())
        start = float(((have - m.targets) ** 2 / (2 * have)).sum())
        assert least - 1e-6 <= loss <= least + .05 * (start - least)  # the tolerance ends the last few percent
        gradient = p @ (((n * r) @ p - m.targets) / have)
        assert (gradient[r <= 1 + 1e-9] > -.1).all()  # raising a rate from the bound gains nothing
    with pytest.raises(RuntimeError):
        mixing.fit_rates(scored, model, {"a": .5, "b": .3}, tolerance=1e-9, iterations=2)


def test_posteriors_are_calibrated(spark):
    """Overlapping domains: a temperature above 1 lowers the held-out log loss, and posteriors spread."""
    r = random.Random(8)
    common, own = [f"c{k}" for k in range(60)], {"a": [f"a{k}" for k in range(5)], "b": [f"b{k}" for k in range(5)]}
    rows, labels = [], []
    for i in range(900):
        y = r.choice("ab")
        mixed = own[y if r.random() < .75 else "ab"[y == "a"]]
        rows.append((i, " ".join(r.choice(mixed if r.random() < .4 else common) for _ in range(30))))
        labels.append((i, y))
    docs = frame(spark, rows)
    model = mixing.fit_domains(docs, spark.createDataFrame(labels, "doc_id long, label string"))
    assert model.temperature > 1 and model.log_loss < model.log_loss_plain and model.log_loss < 0.69
    p = np.array([x.p_a for x in mixing.mix(docs, model, {"a": .5, "b": .5})[0].collect()])
    assert np.mean((p > .05) & (p < .95)) > .9
    with pytest.raises(ValueError):
        mixing.fit_domains(docs, spark.createDataFrame(labels, "doc_id long, label string"), domains=1)


def test_mixing_rows(spark):
    rows = [(i, ("the and of that " if i % 3 else "der die und nicht ") * (i % 5 + 1)) for i in range(60)] + [(100, None), (101, ""), (None, "the of"), (7, "the of"), (102, "the " * 50_000)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, "en" if i % 3 else "de") for i in range(60)] + [(None, "en"), (3, None)], "doc_id long, label string")
    model = mixing.fit_domains(docs, labels)
    assert model.names == ["de", "en"] and "der" in model.words[0] and "the" in model.words[1]
    got, fitted = mixing.mix(docs, model, {"de": 0.5, "en": 0.5})
    out = got.collect()
    assert len(out) == len(rows) and all(r.rate >= 1 and r.copies >= 1 and abs(r.p_de + r.p_en - 1) < 1e-9 for r in out)
    assert {r.domain for r in out if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 3 == 0} == {"de"}
    mixed = mixing.apply_rates(docs, model, {"de": 0.5, "en": 0.5})
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in out)
    bare = mixing.fit_domains(docs, labels.limit(0))
    assert {r.rate for r in mixing.mix(docs, bare)[0].collect()} == {1.0}
    assert mixing.mix(docs.limit(0), model)[0].count() == 0


# Search.

def plain_top(rows, queries, k):
    docs = [(i, Counter((t or "").lower().split())) for i, t in rows if i is not None]
    n, avg = len(docs), sum(sum(c.values()) for _, c in docs) / max(1, len(docs))
    df = Counter(t for _, c in docs for t in c)
    out = {}
    for q, t in queries:
        s = []
        for i, c in docs:
            score = sum(np.log(1 + (n - df[w] + .5) / (df[w] + .5)) * c[w] * 2.2 / (c[w] + 1.2 * (.25 + .75 * sum(c.values()) / avg)) for w in set((t or "").lower().split()) if w in c)
            if any(w in c for w in (t or "").lower().split()):
                s.append((-round(score, 4), i))
        out[q] = [(i, -x) for x, i in sorted(s)[:k]]
    return out


def test_search_counts_beyond_16_bits(spark):
    rows = [(1, "w1 " * 70_000), (2, "w1 " * 300_000), (3, "w1"), *((i, "w3 w4") for i in range(4, 40))]
    docs = frame(spark, rows)
    got = search.top_k(docs, docs.where("doc_id = 3"), 3).orderBy("rank").collect()
    assert [(x.doc_id, x.score) for x in got] == plain_top(rows, [(3, "w1")], 3)[3]


@pytest.mark.parametrize("most", [40, 12_288])
def test_search_is_exact(spark, most):
    r = random.Random(4)
    vocabulary = [f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(3000)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 80)))) for i in range(500)]
    rows += [(500, None), (501, " "), (None, rows[3][1]), (503, rows[3][1]), (504, "W1 " * 20_000)]
    docs = frame(spark, rows)
    asked = docs.where("doc_id % 25 = 0 or doc_id > 499")
    got = defaultdict(list)
    for x in search.top_k(docs, asked, 7, most=most, block_terms=400, sample=3).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.doc_id, x.score))
    want = plain_top(rows, [(i, t) for i, t in rows if i is not None and (i % 25 == 0 or i > 499)], 7)
    assert {q: v for q, v in want.items() if v} == dict(got)
    assert search.top_k(docs.limit(0), docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_search_skips_most_postings():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    rows, term = search.term_rows(t["text"].combine_chunks())
    pair, tf = np.unique(np.stack([term, rows.astype(np.uint64)]), axis=1, return_counts=True)
    terms, n = np.unique(pair[0], return_counts=True)
    ids, lengths = np.asarray(t["doc_id"]), np.bincount(rows, minlength=len(t))
    shard = search.Shard(ids, lengths, terms, np.cumsum(n), pair[1].astype(np.int64), tf, lengths.mean())
    shard.counting = True
    idf = np.log(1 + (len(t) - n + .5) / (n + .5))
    value = idf[np.searchsorted(terms, pair[0])] * tf * 2.2 / (tf + 1.2 * (.25 + .75 * lengths[pair[1].astype(np.int64)] / lengths.mean()))
    for q in range(0, len(t), 25):
        mine = np.unique(term[rows == q])
        found = shard.find(mine, idf[np.searchsorted(terms, mine)])
        often, top = shard.frequent([found])
        shard.counting = False
        first = shard.best(*found, often[0], top[0], 10)
        owned, shard.counting = shard.owned, True
        docs, scores = shard.best(*found, often[0], top[0], 10, first[1].min() if len(first[1]) == 10 else 0.)  # as other shards' thresholds
        shard.owned = owned
        assert sorted(docs.tolist()) == sorted(first[0].tolist())
        every = np.round(np.bincount(pair[1].astype(np.int64), weights=value * np.isin(pair[0], mine), minlength=len(t)), 4)
        order = np.lexsort((ids, -every))[:10]
        assert sorted(docs.tolist()) == sorted(order[every[order] > 0].tolist()) and np.allclose(scores, every[docs], atol=1.01e-4)
    assert 0 < shard.read < 0.5 * shard.owned


ARTICLE = "<article><h1>T</h1><p>This is the text of an article that is long enough and it was here for all of us to read.</p></article>"
WHOLE = "T\nThis is the text of an article that is long enough and it was here for all of us to read."


@pytest.mark.parametrize("before", ["<title-bar></title-bar>", "<select-menu></select-menu>", "<!-->", "<!--->", "<!-- a > b -->", "<template>", "<noscript>", "<canvas/>", "<script-x></script-x>", "<script>var a = '<p>';</script >", "<style></STYLE\n>"])
def test_elements_that_only_begin_like_raw_ones(before):
    assert html_text.main_text(before + ARTICLE) == WHOLE


@pytest.mark.parametrize("before", ["<script>", "<style>", "<!-- never closed"])
def test_what_takes_the_rest_of_the_page(before):
    assert html_text.main_text(ARTICLE + before + ARTICLE) == WHOLE


def test_ids_made_from_titles_are_no_marks():
    page = ('<article><h2 id="related-work">Related work</h2><p>One.</p><h2 id="legal-status">Legal</h2><p>Two.</p><section id="social-impact"><p>Three.</p></section>'
            '<div id="comments"><p>Gone.</p></div><div class="share-buttons">Gone.</div><h3 class="comment-title">Kept</h3></article>')
    assert html_text.main_text(page) == "Related work\nOne.\nLegal\nTwo.\nThree.\nKept"


def test_linked_lines_of_an_article_stay():
    assert html_text.main_text('<article><p>Text.</p><ul><li><a href="#1">Smith 2001</a></li><li><a href="#2">Jones</a></li></ul><p><a href="x">One link</a></p></article>') == "Text.\nSmith 2001\nJones\nOne link"
    menu = "".join(f'<li><a href="/{k}">Item {k}</a></li>' for k in range(5))
    assert "Item" not in html_text.main_text(f"<main><ul>{menu}</ul><p>{'This is the text of a page and it is here for all. ' * 3}</p></main>")


def test_indentation_inside_links_does_not_count():
    text = "This is the text of a page and it is here for all. " * 3
    got = html_text.main_text(f"<p>{text}<a href=x>{' ' * 200}a\n{' ' * 200}link</a></p>")
    assert got == text + "a link"


@pytest.mark.parametrize("unit", ["<title>", "<html ", "<a ", "<noscript>", "<a href='", '<a href="x', "<!--", "<p", "<title>x</title", "<select>"])
def test_a_page_of_unclosed_tags_takes_linear_time(unit):
    import time

    page = unit * (1_000_000 // len(unit))
    began = time.process_time()
    assert len(warc.derive_one("i", "t", "d", None, page, None)) == 2
    assert time.process_time() - began < 5


def test_facts_of_a_page():
    page = ("<!-- <a href='no'> --><html class=x lang='de-AT'><head><title>One &amp;\n two</title><title>other</title></head><script>'<a href=\"no\">'</script>"
            "<a name=x>no</a><A HREF=one>1</A><a class='b' href=\"two &amp; three\">2</a><a href>4</a>")
    assert warc.facts(page) == ("One & two", "de-AT", ["one", "two & three", ""])
    assert warc.facts("<title>never closed <a href=x>") == (None, None, ["x"])


@pytest.mark.parametrize("unit", ["a@b.co x [at] y [dot] co ", "x[at]y[dot]co;", "four one five 5551234 ", "ａ@b.co ", "a@b.co,x(at)y.co,"])
def test_mixed_plain_and_disguised_addresses_take_linear_time(unit):
    import time

    text = unit * (1_000_000 // len(unit))
    began = time.process_time()
    pii.hidden(text, pii.find(text))
    assert time.process_time() - began < 12


def test_added_spans_never_cut_base_spans():
    rng = random.Random(2)
    for _ in range(2_000):
        base = []
        at = 0
        while at < 60:
            at += rng.randrange(1, 9)
            end = at + rng.randrange(1, 7)
            base.append((at, end))
            at = end + rng.randrange(0, 3)
        a = rng.randrange(0, 60)
        span = (a, a + rng.randrange(1, 30))
        plain = span in base or any(x < span[1] and span[0] < y and not (span[0] <= x and y <= span[1]) for x, y in base)
        assert pii._spoils(span, base, [x for x, _ in base]) == plain


def test_training_does_not_depend_on_hash_seeds():
    """The same machine whatever order sets have."""
    import subprocess
    import sys

    code = ("import random; from measura.llm import toxicity as t; r = random.Random(1); w = [''.join(r.choices('abcdefgh', k=5)) for _ in range(3000)];"
            "s = [(0, r.sample(w, 60)) for _ in range(80)] + [(1, r.sample(w, 30) + ['idiotzz' + str(k % 3)]) for k in range(30)];"
            "m = t.train(s, most_negative=500, landmarks=32, rounds=2); print(round(float(abs(m.weights).sum()), 6), round(m.bias, 9))")
    got = {subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": str(seed), "OMP_NUM_THREADS": "1"}, capture_output=True, text=True, check=True,
                          cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))).stdout for seed in (1, 2, 3)}
    assert len(got) == 1


def test_samples_are_the_smallest_hashes(spark):
    from measura.llm.common import sample_share

    df = spark.range(20_000).withColumnRenamed("id", "i").withColumn("y", F.lit(1))
    want = {r.i for r in df.withColumn("h", F.pmod(F.xxhash64("i", F.lit(7)), F.lit(1 << 30))).orderBy("h", "i").limit(300).collect()}
    for parts in (1, 7):
        got = [r.i for r in sample_share(df.repartition(parts), "i", 300 / 20_000, 300).collect()]
        assert len(got) == 300 and set(got) == want
    assert sample_share(df, "i", 2.0, 40_000).count() == 20_000


def test_search_bounds_its_shards(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        search.top_k(docs, docs, most=40_001)


def test_domains_whose_names_differ_in_case(spark):
    rows = [(i, ("the and of that " if i % 3 else "der die und nicht ") * (i % 5 + 1)) for i in range(60)]
    labels = spark.createDataFrame([(i, "w" if i % 3 else "W") for i in range(60)], "doc_id long, label string")
    model = mixing.fit_domains(frame(spark, rows), labels)
    assert model.names == ["W", "w"]
    got = mixing.mix(frame(spark, rows), model, {"w": 0.5})[0]
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    assert {r.doc_id for r in got.where("domain = 'W'").collect()} == set(range(0, 60, 3))


def test_small_domains_meet_their_targets(spark):
    """Each domain is off by a share of its own target, not of the mixture's."""
    rows = [(10, [1.0, 0.0])] * 300 + [(10, [0.1, 0.9])] * 3
    scored = spark.createDataFrame(rows, "__n int, __p array<double>")
    m = mixing.fit_rates(scored, mixing.Domains(["a", "b"], [[], []], [0.0] * 2, [[0.0] * 2] * 2), {"a": 0.97, "b": 0.03}, total=2.0)
    assert not m.at_bound and all(abs(x - y) <= 2e-3 * y for x, y in zip(m.reached, m.targets)) and len(m.steps) > 1
    stuck = mixing.fit_rates(scored, mixing.Domains(["a", "b"], [[], []], [0.0] * 2, [[0.0] * 2] * 2), {"a": 0.02, "b": 0.98})
    assert stuck.at_bound and stuck.reached[0] > 1.01 * stuck.targets[0]  # every text of b is partly one of a


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_quality_is_told_apart(spark):
    """Labelled texts by language and quality, held-out ones included: far better than always saying good; the targets need the solver."""
    from measura.llm.queries import TARGETS, domains_of

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = domains_of(docs, labels)
    got, fitted = mixing.mix(docs, model, TARGETS)
    assert model.accuracy > 0.93 and len(fitted.steps) > 1
    told = got.join(labels, "doc_id").select((F.substring("domain", -1, 1).cast("int") == F.col("quality")).cast("int").alias("right"), "quality")
    share = told.agg(F.avg("right"), F.avg("quality")).first()
    assert share[0] > 0.95 > 0.9 > share[1]
