"""Interaction of quality filters: what each filter removes in every order of applying them.

Each document gets a mask, one bit for each filter that it fails, whichever filters came before. Documents are counted by part and mask:
at most ``2 ** filters`` cells a part, combined before the shuffle, so a part of any size is a few rows. A recursive query then extends
filter prefixes with unused letters, joins the part's cells and carries the applied bits; each level of the recursion gives that step's
metrics. A prefix is counted once and shared by all orders that begin with it. Rows are parts times prefixes (325 for five filters),
whatever the number of documents; texts are read once.

Duplicates: a text is known by its SHA-256. The first row of a text is found by an aggregate; whether a row is its text's first is
asked by (digest, id), so a text with very many copies puts no more rows into one task than another.

Defined cases: null text counts as empty; null and empty part are one part. Rows without an id come last: such a row is a duplicate if a
row with an id has its text. Rows given twice (equal id and text) are counted twice and are no duplicates of each other. A document with
several label rows has a label if one of them says so; a document without has none. An empty table gives no rows. Other columns,
whatever their names, are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize

LAST = (1 << 63) - 1
#: The letter of the duplicate filter.
DUPLICATE = "E"


def default_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter: short, repetitive, much upper case, symbols."""
    words = F.array_remove(F.split(text, SPACE), "")
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {"A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            "C": 100 * upper > 2 * F.length(text), "D": text.rlike("[#$%&*|]")}


def mask_cells(docs: DataFrame, flags: DataFrame, filters: dict[str, Column], part: Column, id_col: str, text: Column) -> DataFrame:
    """(part, cells): for each part an array of (mask, n, good, toxic). ``flags``: id, good, toxic."""
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(filters.values())), F.lit(0))
    own = docs.select(F.coalesce(F.col(id_col), F.lit(LAST)).alias("i"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("g"), part.alias("part"), bits.alias("bits"))
    rows = materialize(own.groupBy("i", "g", "part", "bits").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    first = rows.groupBy("g").agg(F.min("i").alias("i")).withColumn("first", F.lit(True))
    known = flags.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    marked = rows.join(first, ["g", "i"], "left").join(known, "i", "left")
    mask = F.col("bits") + F.when(F.col("first").isNull(), 1 << len(filters)).otherwise(0)
    cells = marked.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


#: Document counts of one step. ``s`` is the prefix before it, ``l`` its letter, ``m`` a mask cell.
FAILS, EARLIER = "(m.mask & l.bit) <> 0", "(m.mask & s.applied) <> 0"
METRICS = {
    "kept": ("n", "(m.mask & (s.applied | l.bit)) = 0"),
    "removed": ("n", f"{FAILS} AND NOT {EARLIER}"),
    "redundant": ("n", f"{FAILS} AND {EARLIER}"),
    "unique_fails": ("n", "m.mask = l.bit"),
    "good_lost": ("good", f"{FAILS} AND NOT {EARLIER}"),
    "toxic_lost": ("toxic", f"{FAILS} AND NOT {EARLIER}"),
}


def prefixes(cells: DataFrame, letters: str) -> DataFrame:
    """(part, path, step, metrics): every ordered choice of filters, by recursion. ``path`` ends with the step's filter."""
    spark = cells.sparkSession
    each = ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << k})" for k, c in enumerate(letters))
    unused = f"filter(array({each}), l -> (s.applied & l.bit) = 0)"
    counts = [f"aggregate(c.cells, 0L, (x, m) -> x + IF({where}, m.{what}, 0L))" for what, where in METRICS.values()]
    sql = f"""WITH RECURSIVE steps(part, path, step, applied, {", ".join(METRICS)}) AS (
        SELECT part, '', 0, 0, {", ".join("0L" for _ in METRICS)} FROM {{cells}}
        UNION ALL
        SELECT s.part, concat(s.path, l.letter), s.step + 1, s.applied | l.bit, {", ".join(counts)}
        FROM steps s JOIN {{cells}} c ON c.part = s.part LATERAL VIEW explode({unused}) e AS l)
        SELECT part, path, step, {", ".join(METRICS)} FROM steps WHERE step > 0"""
    # The recursion ends with the letters; its row limit is meant for queries that may not end.
    limit, rows = "spark.sql.cteRecursionRowLimit", spark.conf.get("spark.sql.cteRecursionRowLimit", None)
    spark.conf.set(limit, "-1")
    try:
        return materialize(spark.sql(sql, cells=cells), "audit-prefixes")
    finally:
        spark.conf.set(limit, rows) if rows else spark.conf.unset(limit)


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, part: str = "source", id_col: str = "doc_id",
                 text_col: str = "text", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step.

    ``filters``: failure conditions over the columns of ``docs`` by letter, at most six; duplicates (E) come after them. ``shapley`` is
    what the step's filter removes, summed over all orders."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    filters = filters or default_filters(text)
    letters = "".join(filters) + DUPLICATE
    if len(set(letters)) < len(letters) or not 2 <= len(letters) <= 7 or any(len(c) != 1 for c in filters):
        raise ValueError(f"one to six filters by different letters other than {DUPLICATE}")
    flags = labels.select(id_col, (F.col(good) == 1).alias("good"), (F.col(toxic) == 1).alias("toxic"))
    cells = materialize(mask_cells(docs, flags, filters, F.coalesce(F.col(part), F.lit("")), id_col, text), "audit-cells")
    found = prefixes(cells, letters)
    orders = found.where(F.col("step") == len(letters)).select("part", F.col("path").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    own = orders.withColumn("path", F.expr("substring(filter_order, 1, step)")).join(found.drop("step"), ["part", "path"])
    # What each filter removes in all orders: a prefix stands for all orders that begin with it.
    n, orders_of = len(letters), [1]
    for k in range(1, n):
        orders_of.append(orders_of[-1] * k)
    times = F.element_at(F.lit(orders_of[::-1]), F.col("step"))
    shapley = found.groupBy("part", F.right("path", F.lit(1)).alias("letter")).agg(F.sum(F.col("removed") * times).cast("long").alias("shapley"))
    got = own.withColumn("letter", F.right("path", F.lit(1))).join(shapley, ["part", "letter"])
    return got.select("part", "filter_order", "step", *METRICS, "shapley")
