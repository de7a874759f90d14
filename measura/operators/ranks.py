"""Places of rows in an order, by range.

Rows are dealt into ranges of the order and sorted there; the counts of the ranges say where each begins. Ranges follow the data, so the
number of tasks grows with the rows and no task sorts a whole table or a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .quantiles import meet


def placed(df: DataFrame, order: list[str], name: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of columns ``order`` within groups ``by``; or with the sum of ``weight``
    of the rows before it. Written once. Rows that are equal in all these columns come in any order."""
    by = by or []
    ranges = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    ranked = written(ranges.withColumn("__m", F.monotonically_increasing_id()), "ranges")
    # The upper bits of the number are the range's, the lower ones count its rows.
    ranked = ranked.withColumn("__r", F.shiftright("__m", 33))
    own = F.sum(weight).alias("__c") if weight else F.count(F.lit(1)).alias("__c")
    counts = ranked.groupBy(*by, "__r").agg(F.min("__m").alias("__lo"), own)
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__s", F.coalesce(F.sum("__c").over(before), F.lit(0)))  # a row for each range, and for each group in it
    got = meet(ranked, starts.drop("__c"), [*by, "__r"])
    if weight:
        inside = Window.partitionBy(*by, "__r").orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)
        return got.withColumn(name, F.col("__s") + F.coalesce(F.sum(weight).over(inside), F.lit(0))).drop("__m", "__r", "__lo", "__s")
    return got.withColumn(name, F.col("__s") + F.col("__m") - F.col("__lo")).drop("__m", "__r", "__lo", "__s")


def counts_upto(values: DataFrame, asked: DataFrame, by: list[str], value: str, strict: str, name: str) -> DataFrame:
    """``asked`` with how many of ``values`` (by, value) lie below its ``value`` where ``strict``, at or below it elsewhere; by group.

    Values are counted first, so one that comes very often is one row."""
    one = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")).withColumn("__o", F.lit(1))
    questions = asked.withColumns({"__n": F.lit(0).cast("long"), "__o": F.when(F.col(strict), 0).otherwise(2)})
    both = questions.unionByName(one, allowMissingColumns=True)
    return placed(both, [value, "__o"], name, by, "__n").where(F.col("__o") != 1).drop("__n", "__o")


def digamma(n: Column) -> Column:
    """The digamma function of numbers from 1 on, to about 1e-12."""
    z = n + 8
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z ** 2) + 1 / (120 * z ** 4) - 1 / (252 * z ** 6) + 1 / (240 * z ** 8) - 1 / (132 * z ** 10)
    return series - sum((1 / (n + k) for k in range(1, 8)), 1 / n)
