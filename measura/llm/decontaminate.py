"""Benchmark items in training documents, by a positional inverted index.

The index holds a posting (document, position) for each training word that a benchmark item also has. Each item is cut into windows of
consecutive words. A window's rarest words come first: their postings, moved back by the word's place in the window, are candidate
places; the lists of the next rarest words are intersected with these, moved by their own places, and at last all other words' lists,
of the documents that are left. A place that all lists share holds the window, word by word, so the index alone gives exact phrases. With
``slop`` the lists need to agree up to so many words only (proximity).

Everything is DataFrame expressions. Joins are by (document, position, word), so frequent words, common passages and long documents are
spread by place. Words, windows and their lists come from the benchmark: they are broadcast up to a checked number of rows and joined by
shuffle beyond it, where tokens of frequent words are salted.

Defined cases: null texts have no words. Rows without a document id, and rows with equal ids, are told apart by a 64-bit hash of their
texts; rows given twice have equal results. Items without an id do not take part; items given twice count once. Empty tables give
documents without hits, or no rows. Other columns, whatever their names, are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, discard, materialize

LAST = (1 << 63) - 1
#: Words hold digits, ASCII letters and everything beyond ASCII; these separate them.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SALTS = 32
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Words of a text, A to Z in lower case and no other letter. ``lower`` does that for ASCII texts."""
    ascii_only = F.length(text) == F.octet_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), BETWEEN), "")


def _keys(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col), F.lit(LAST)).alias("d"), F.xxhash64(text_col).alias("h")]


def meet(tokens: DataFrame, listed: DataFrame, on: str, most: int = 1_000_000) -> DataFrame:
    """Tokens joined with benchmark rows on a word: broadcast if there are few, else by shuffle with the tokens of a word in ``SALTS``
    parts."""
    if listed.count() <= most:
        return tokens.join(F.broadcast(listed), on)
    salted = listed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return tokens.withColumn("__salt", F.pmod("pos", F.lit(SALTS))).join(salted, [on, "__salt"]).drop("__salt")


def windows_of(items: DataFrame, length: int = 10, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(w, words): the distinct windows; (w, item): the items that have them. Both written."""
    own = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (length - 1), F.lit(1)))
    each = own.select("item", F.explode(F.transform(starts, lambda k: F.slice("ws", k, length))).alias("words")).distinct()
    each = materialize(each, "windows-of-items")
    found = materialize(each.select("words").distinct().withColumn("w", F.monotonically_increasing_id()), "windows")
    return found, materialize(each.join(found, "words").select("w", "item"), "window-items")


def build_index(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(t, d, h, pos): postings of the training words that windows have. (t, word, n): these words by number, with how many postings they
    have. Both written."""
    terms = materialize(found.select(F.explode("words").alias("word")).distinct().withColumn("t", F.monotonically_increasing_id()), "terms")
    tokens = docs.select(*_keys(id_col, text_col), F.posexplode(words(F.col(text_col))).alias("pos", "word"))
    postings = materialize(meet(tokens, terms, "word").select("t", "d", "h", "pos"), "postings")
    counts = postings.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return postings, materialize(terms.join(counts, "t"), "term-counts")


def lists_of(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(w, length, lists): for each window whose words all have postings, its words' first places, (n, t, o), the rarest first; ``more``
    holds the later places of words that come again."""
    each = found.select("w", F.size("words").alias("length"), F.posexplode("words").alias("o", "word"))
    # A window has ten words: its rows are few.
    got = each.join(counts, "word", "left").groupBy("w", "length").agg(F.array_sort(F.collect_list(F.struct("n", "t", "o"))).alias("lists"), F.count("t").alias("__k"))
    got = got.where(F.col("__k") == F.col("length")).drop("__k")
    again = F.transform("lists", lambda x, i: F.struct((F.filter("lists", lambda y: (y["t"] == x["t"]) & (y["o"] < x["o"]))).alias("s"), x.alias("x")))
    first = F.transform(F.filter(again, lambda y: F.size(y["s"]) == 0), lambda y: y["x"])
    more = F.transform(F.filter(again, lambda y: F.size(y["s"]) > 0), lambda y: y["x"])
    return materialize(got.select("w", "length", first.alias("lists"), more.alias("more")), "window-lists")


PLACE = ["d", "h", "at", "w"]


def _intersect(places: DataFrame, wanted: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    """(d, h, at, w, k) for each place and wanted word (w, t, o) with a posting at ``at + o``, up to ``slop`` words off; ``k`` numbers
    the window's wanted words."""
    asked = places.join(checked_broadcast(wanted), "w")
    if not slop:
        asked = asked.withColumn("pos", (F.col("at") + F.col("o")).cast("int"))
        return asked.join(postings, ["d", "h", "pos", "t"], "left_semi").select(*PLACE, "k")
    # Postings in cells of slop + 1 words: what is near lies in the same or in a neighbouring cell.
    cell = F.floor(F.col("pos") / (slop + 1)).alias("cell")
    ask = asked.withColumn("want", F.col("at") + F.col("o"))
    ask = ask.withColumn("cell", F.explode(F.transform(F.lit([-1, 0, 1]), lambda x: x + F.floor(F.col("want") / (slop + 1)))))
    have = postings.select("d", "h", "t", F.col("pos").alias("p"), cell)
    return ask.join(have, ["d", "h", "t", "cell"]).where(F.abs(F.col("p") - F.col("want")) <= slop).select(*PLACE, "k").distinct()


def matches(postings: DataFrame, lists: DataFrame, slop: int = 0, ranks: int = 3) -> DataFrame:
    """(d, h, at, w): document, first word and window of each match. Written.

    ``slop`` 0 gives exact phrases. Above, the rarest word stands for the place and each other place of the window must have its word up
    to ``slop`` words off. The ``ranks`` rarest words are intersected one list after the other, then all others at once."""
    def asked(k: int) -> DataFrame:
        x = F.element_at("lists", k + 1)
        return lists.where(F.size("lists") > k).select("w", x["t"].alias("t"), x["o"].alias("o"), F.lit(k).alias("k"))

    rarest = meet(postings, asked(0).drop("k"), "t").select("d", "h", (F.col("pos") - F.col("o")).alias("at"), "w")
    got = materialize(rarest.where("at >= 0") if not slop else rarest, "places-0")
    for k in range(1, ranks):
        wanted = asked(k)
        some = postings.join(checked_broadcast(wanted.select("t").distinct()), "t", "left_semi")
        kept = _intersect(got, wanted, some, slop).select(*PLACE)
        # Windows of fewer words than this have been intersected in full.
        before, got = got, materialize(kept.unionByName(got.join(checked_broadcast(wanted.select("w")), "w", "left_anti").select(*PLACE)), f"places-{k}")
        discard(before)
    rest = F.concat(F.slice("lists", ranks + 1, F.greatest(F.size("lists") - ranks, F.lit(0))), "more")
    wanted = lists.select("w", F.posexplode(rest).alias("k", "x")).select("w", "k", F.col("x.t").alias("t"), F.col("x.o").alias("o"))
    numbers = lists.select("w", F.size(rest).alias("own"))
    left = postings.join(checked_broadcast(got.select("d", "h").distinct()), ["d", "h"], "left_semi")
    met = _intersect(got, wanted, left, slop).distinct().groupBy(*PLACE).agg(F.count(F.lit(1)).alias("k"))
    full = met.join(checked_broadcast(numbers), "w").where(F.col("k") == F.col("own")).select(*PLACE)
    none = got.join(checked_broadcast(numbers.where("own = 0")), "w", "left_semi").select(*PLACE)
    return materialize(full.unionByName(none).distinct(), "matches")  # rows given twice have the same places


def decontaminate(docs: DataFrame, items: DataFrame, length: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted as strings).

    A word is hit if a window of an item covers it. An item of fewer words than ``length`` is one window."""
    found, of_items = windows_of(items, length, item_col, item_text)
    postings, counts = build_index(docs, found, id_col, text_col)
    got = matches(postings, lists_of(found, counts))
    discard(postings)
    sizes = checked_broadcast(found.select("w", F.size("words").alias("length")))
    hit = got.join(sizes, "w").select("d", "h", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)).alias("pos"))
    hits = hit.groupBy("d", "h", "pos").agg(F.lit(1).alias("one")).groupBy("d", "h").agg(F.count(F.lit(1)).alias("n_hit"))
    pairs = got.select("d", "h", "w").distinct().join(checked_broadcast(of_items), "w").select("d", "h", F.col("item").cast("string").alias("item")).distinct()
    names = pairs.groupBy("d", "h").agg(F.array_sort(F.collect_list("item")).alias("items"))
    bad = materialize(hits.join(names, ["d", "h"]), "contaminated")
    n_words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    every = docs.select(F.col(id_col).alias("id"), *_keys(id_col, text_col), n_words.alias("n_words"))
    out = every.join(checked_broadcast(bad), ["d", "h"], "left")
    mine = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(mine).cast("long").alias("n_items"),
                      F.sha2(F.array_join(mine, ",").cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), mine.alias("items"))
