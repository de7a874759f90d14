"""Conflicting measurements and gold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written


def in_range(df: DataFrame, low: float, high: float, value: str = "value") -> DataFrame:
    """Both bounds belong to the range (P07). It goes before any resolution: values outside must not enter a median."""
    return df.where(F.col(value).between(low, high))


def resolve_conflicts(df: DataFrame, order: list[str], policy: str = "median", exclude: str | None = None, key: str = "key",
                      value: str = "value", source: str = "source", meta: list[str] | None = None, hot: DataFrame | str | None = "find") -> DataFrame:
    """One row for each key.

    policy: ``median`` of all values; ``first`` by ``order``; ``exclude`` takes the median without source ``exclude`` and falls
    back to all values where nothing is left. The other columns are those of the first row by ``order``, which must sort rows
    completely. Of several sources the name is the sorted distinct ones joined by ``+``. One shuffle on the key, what a task holds
    combined before it. An exact median keeps a key's distinct values together; for hot keys it is found by ``spread_median``
    instead. They are found by a count of the keys first (``hot_keys``; few rows, broadcast); ``hot`` may name them, or None say that
    there are none.
    """
    rest = meta if meta is not None else [c for c in df.columns if c not in (key, value, source)]
    first = F.min_by(F.struct(value, source, *rest), F.struct(*order))
    if policy not in ("median", "first", "exclude"):
        raise ValueError(f"unknown policy {policy}")
    counted, spread = F.col(value), None
    if policy == "first":
        hot = None
    elif isinstance(hot, str):
        hot = written(hot_keys(df, key), "hot")
        hot = hot if hot.head(1) else None
    if hot is not None:
        hot = hot.where(F.col(key).isNotNull()).select(F.col(key).alias("__hot"))
        df = df.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
        few = df.where("__hot is not null")
        spread = spread_median(few, key, value)
        if policy == "exclude":  # the others' median where there are others
            others = spread_median(few.where(F.col(source) != exclude), key, value)
            spread = others.unionByName(spread.join(F.broadcast(others.select(key)), key, "left_anti"))
        counted = F.when(F.col("__hot").isNull(), F.col(value))
    median = F.median(counted)
    if policy == "exclude":
        median = F.coalesce(F.median(F.when(F.col(source) != exclude, counted)), median)
    sources = F.array_join(F.array_sort(F.collect_set(source)), "+")
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), median.alias("__median"), first.alias("__first"), sources.alias("__sources"))
    if spread is not None:
        out = out.join(F.broadcast(spread.withColumnRenamed("median", "__spread")), key, "left").withColumn("__median", F.coalesce("__spread", "__median"))
    single = F.col("__n") == 1
    chosen = F.col(f"__first.{value}") if policy == "first" else F.when(single, F.col(f"__first.{value}")).otherwise(F.col("__median"))
    return out.select(key, chosen.alias(value), F.col("__sources").alias(source), *(F.col(f"__first.{c}").alias(c) for c in rest))


def hot_keys(df: DataFrame, key: str = "key", share: int = 1_000) -> DataFrame:
    """Keys that hold more than one ``share``-th of the rows; fewer than ``share`` of them exist."""
    n = df.agg((F.count(F.lit(1)) / share).alias("__t"))
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return sizes.join(F.broadcast(n)).where((F.col("__n") > F.col("__t")) & (F.col("__n") > 1_000)).select(key)


def spread_median(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Exact medians (key, median) without a key's values in one task: values are counted, approximate quantiles cut them into
    ranges, and exact counts of the ranges lead to the one or two values in the middle."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    edges = df.groupBy(key).agg(F.percentile_approx(value, F.lit([k / 256 for k in range(1, 256)]), F.lit(2_000)).alias("e"))
    cut = counts.join(F.broadcast(edges), key).withColumn("b", F.size(F.filter("e", lambda x: x < F.col(value)))).drop("e")
    sizes = cut.groupBy(key, "b").agg(F.sum("n").alias("m"))  # 256 rows for each key at most
    over = Window.partitionBy(key)
    start = F.coalesce(F.sum("m").over(over.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(key, "b", start.alias("s"), F.sum("m").over(over).alias("t"), "m")
    low, high = F.floor((F.col("t") - 1) / 2), F.floor(F.col("t") / 2)
    # only the ranges that the middle falls into are looked at closely
    middle = starts.where((F.col("s") <= high) & (F.col("s") + F.col("m") > low))
    before = F.col("s") + F.coalesce(F.sum("n").over(Window.partitionBy(key, "b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cut.join(F.broadcast(middle), [key, "b"]).withColumn("p", before)
    has = lambda at: (F.col("p") <= at) & (F.col("p") + F.col("n") > at)
    return placed.groupBy(key).agg(((F.max(F.when(has(low), F.col(value))) + F.max(F.when(has(high), F.col(value)))) / 2).alias("median"))


def resolution_statistics(df: DataFrame, key: str = "key", value: str = "value", canonical: Column | None = None, wide: float = 10.0) -> DataFrame:
    """One row (A03): rows before and after, merged rows, keys whose values span more than ``wide``, keys without canonical form."""
    failed = F.count_if(canonical.isNull()) if canonical is not None else F.lit(0).cast("long")
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.max(value) - F.min(value)).alias("span"), failed.alias("failed"))
    return groups.agg(F.sum("n").alias("rows_before"), F.count(F.lit(1)).alias("rows_after"), F.sum(F.col("n") - 1).alias("merged"),
                      F.count_if(F.col("span") > wide).alias("wide"), F.sum("failed").alias("no_canonical"))


def first_rows(df: DataFrame, order: list[str], key: str = "key") -> DataFrame:
    """The first row of each key (W01). An aggregate of the least row combines before the shuffle, which a window cannot."""
    rest = [c for c in df.columns if c != key]
    got = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return got.select(*(F.col(c) if c == key else F.col(f"__r.{c}").alias(c) for c in df.columns))


def prefer_gold(gold: DataFrame, other: DataFrame, key: str = "key") -> DataFrame:
    """Rows of ``other`` whose key the gold table does not have; rows without a key stay."""
    return other.join(gold.select(key).distinct(), key, "left_anti")


def unify(gold: DataFrame, other: DataFrame, order: list[str], key: str = "key") -> DataFrame:
    """The gold rows, medians within gold, and first rows of the others that gold lacks, tagged with ``origin``."""
    best = resolve_conflicts(gold, order, key=key)
    rest = first_rows(prefer_gold(gold, other, key), order, key)
    return best.withColumn("origin", F.lit("gold")).unionByName(rest.withColumn("origin", F.lit("other")), allowMissingColumns=True)


def numbered(df: DataFrame, by: str, order: list[str], name: str = "number") -> DataFrame:
    """Rows numbered from 0 within ``by``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
