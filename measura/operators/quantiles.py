"""Exact interpolated quantiles of whole tables and of large groups, without a group's values in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

#: Ranges of a group, and edges that are looked up at once.
RANGES, STEP = 256, 16


def meet(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` on columns of equal names, NULL meeting NULL; the columns of ``a``, then the others of ``b``."""
    other = b.withColumnsRenamed({c: f"__r_{c}" for c in names})
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in names), F.lit(True))
    return a.join(other, same, how).drop(*(f"__r_{c}" for c in names))


def quantiles(df: DataFrame, value: str, levels: list[float | Column], by: list[str] | None = None) -> DataFrame:
    """(by..., __q): an array with the quantile at each level, for groups that have values.

    A level is a number from 0 to 1 or an expression of ``__t``, the group's number of values. Values are counted; approximate
    quantiles cut a group's distinct values into ranges, whose exact counts tell in which ranges the wanted places lie; only these few
    ranges are sorted. Without ``by`` the whole table is one group."""
    return quantiles_of_counts(value_counts(df, value, by), levels, by)


def value_counts(df: DataFrame, value: str, by: list[str] | None = None, nulls: bool = False) -> DataFrame:
    """(by..., __v, __n): how often each value comes in each group; with ``nulls`` NULL, too. Written, so ``df`` is read once."""
    known = (df if nulls else df.where(F.col(value).isNotNull())).select(*(by or []), F.col(value).cast("double").alias("__v"))
    return written(known.groupBy(*(by or []), "__v").agg(F.count(F.lit(1)).alias("__n")), "counts")


def quantiles_of_counts(counts: DataFrame, levels: list[float | Column], by: list[str] | None = None) -> DataFrame:
    """``quantiles`` from ``value_counts``."""
    by = by or []
    if not by:
        return quantiles_of_counts(counts.withColumn("__g", F.lit(1)), levels, ["__g"]).drop("__g")
    edges = counts.groupBy(*by).agg(F.percentile_approx("__v", F.lit([k / RANGES for k in range(1, RANGES)]), F.lit(8 * RANGES)).alias("__e"), F.sum("__n").alias("__t"))
    # Written, so that Spark knows how small edges and wanted ranges are: else all counts of a group are shuffled to one task to meet them.
    edges = written(edges.withColumn("__c", F.array(*(F.element_at("__e", k) for k in range(STEP, RANGES, STEP)))), "edges")
    cut = meet(counts, edges, by).select(*by, "__v", "__n", "__t", _edges_below("__e", "__c", "__v").alias("__b"))
    sizes = cut.groupBy(*by, "__b").agg(F.sum("__n").alias("__m"), F.first("__t").alias("__t"))  # RANGES rows for each group at most
    start = F.coalesce(F.sum("__m").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = F.array(*((F.lit(x) if isinstance(x, (int, float)) else x) * (F.col("__t") - 1) for x in levels))
    wanted = sizes.withColumn("__s", start).select(*by, "__b", "__s", "__m", F.posexplode(places).alias("__k", "__p"))
    wanted = written(wanted.where((F.col("__s") <= F.ceil("__p")) & (F.col("__s") + F.col("__m") > F.floor("__p"))).select(*by, "__b", "__s", "__k", "__p"), "wanted")
    few = wanted.select(*by, "__b", "__s").distinct()
    inside = meet(cut, few, [*by, "__b"]).select(*by, "__b", "__v", "__n", "__s")
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = inside.withColumn("__f", F.col("__s") + before).drop("__s")
    met = meet(placed, wanted.drop("__s"), [*by, "__b"]).select(*by, "__v", "__n", "__f", "__k", "__p")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("__f") <= place) & (F.col("__f") + F.col("__n") > place), F.col("__v")))

    ends = met.groupBy(*by, "__k", "__p").agg(at(F.floor("__p")).alias("__lo"), at(F.ceil("__p")).alias("__hi"))
    part = F.col("__p") - F.floor("__p")
    each = ends.select(*by, F.struct("__k", ((1 - part) * F.col("__lo") + part * F.col("__hi")).alias("q")).alias("__x"))
    return each.groupBy(*by).agg(F.array_sort(F.collect_list("__x")).alias("__x")).select(*by, F.col("__x.q").alias("__q"))  # a number for each level


def _edges_below(edges: str, steps: str, value: str) -> Column:
    """How many of the sorted edges lie below the value: whole steps of ``STEP`` first, then the edges of one step."""
    whole = STEP * F.size(F.filter(steps, lambda e: e < F.col(value)))
    return whole + F.size(F.filter(F.slice(edges, whole + 1, STEP), lambda e: e < F.col(value)))


def join_quantiles(df: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """``df``, one row for each group, with column ``__q``; NULL for groups without values."""
    if not by:
        return df.join(F.broadcast(found.agg(F.first("__q").alias("__q"))))  # one row
    return meet(df, found, by, "left")
