"""Source quality and overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .quantiles import join_quantiles, meet, quantiles_of_counts
from .quantiles import value_counts as value_counts_of


def describe(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, min, max, mean, median and population deviation."""
    by = by or []
    # Values are counted by value first, so neither a group's median nor its distinct values meet in one task; all else follows from the counts.
    # NULLs are counted too: a group without values has a row.
    counts = value_counts_of(df, value, by, nulls=True)
    v, n, known = F.col("__v"), F.col("__n"), F.col("__v").isNotNull()
    total, kind = F.sum(F.when(known, n)), df.schema[value].dataType
    g = written(counts.groupBy(*by).agg(F.coalesce(total, F.lit(0)).alias("n"), F.min(v).cast(kind).alias("low"), F.max(v).cast(kind).alias("high"), (F.sum(v * n) / total).alias("mean"), F.count(v).alias("distinct")), "described")
    # The squares are of differences from the mean: a row for each group meets the counts.
    off = v - F.col("__mean")
    spread = meet(counts.where(known), g.select(*by, F.col("mean").alias("__mean")), by).groupBy(*by).agg(F.sqrt(F.sum(n * off * off) / F.sum(n)).alias("deviation"))
    g = join_quantiles(g, quantiles_of_counts(counts.where(known), [0.5], by), by).withColumn("median", F.col("__q")[0]).drop("__q")
    return (meet(g, spread, by, "left") if by else g.join(F.broadcast(spread))).select(*by, "n", "low", "high", "mean", "deviation", "median", "distinct")


def source_profile(df: DataFrame, valid: Column, size: Column, key: str = "key", value: str = "value", source: str = "source",
                   low: float = 100, high: float = 900, examples: int = 5) -> DataFrame:
    """Per source: parse rate, outliers on both sides, short keys, small entities and the first invalid keys."""
    # The first invalid keys come as a top-k of distinct ones: what a task keeps is ``examples`` keys for each source.
    bad = df.where(~valid & F.col(key).isNotNull()).select(F.col(source).alias("__s"), F.col(key).alias("__k")).distinct()
    first = bad.withColumn("__r", F.row_number().over(Window.partitionBy("__s").orderBy("__k"))).where(F.col("__r") <= examples)
    first = first.groupBy("__s").agg(F.array_sort(F.collect_list("__k")).alias("__i"))
    got = df.groupBy(source).agg(
        F.count(F.lit(1)).alias("n"), F.avg(valid.cast("int")).alias("parse_rate"), F.count_if(F.col(value) < low).alias("low"),
        F.count_if(F.col(value) > high).alias("high"), F.count_if(F.length(key) < 5).alias("short_keys"), F.count_if(size < 3).alias("small"))
    none = F.array().cast("array<string>")
    return got.join(first, F.col(source).eqNullSafe(F.col("__s")), "left").withColumn("invalid_examples", F.coalesce("__i", none)).drop("__s", "__i")


def value_counts(df: DataFrame, *by: str) -> DataFrame:
    """A06."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def cross_source_conflicts(df: DataFrame, key: str = "key", value: str = "value", source: str = "source") -> DataFrame:
    """Keys that several sources have, with the span of their values and each source's mean."""
    per = df.groupBy(key, source).agg(F.avg(value).alias("v"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    groups = per.groupBy(key).agg(F.count(F.lit(1)).alias("sources"), (F.max("hi") - F.min("lo")).alias("span"),
                                  F.array_sort(F.collect_list(F.struct(source, F.round("v", 6).alias("v")))).alias("by_source"))
    return groups.where("sources > 1")


def overlap_matrix(df: DataFrame, key: str = "key", source: str = "source") -> DataFrame:
    """Shared keys of each pair of sources, and their share of the smaller one in percent.

    Keys come with the short array of their sources, so pairs are made inside a key and no table is joined with itself."""
    sets = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(source)).alias("s"))
    one = F.explode("s").alias("a")
    pairs = sets.select("s", one).select("a", F.explode("s").alias("b")).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    size = sets.select(one).groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.join(F.broadcast(size), "a").join(F.broadcast(size.select(F.col("a").alias("b"), F.col("n").alias("m"))), "b")
    return both.select("a", "b", "shared", (100 * F.col("shared") / F.least("n", "m")).alias("percent"))


def exclusive_keys(df: DataFrame, key: str = "key", source: str = "source") -> DataFrame:
    """Keys that exactly one source has, by source."""
    only = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(source).alias("a"), F.max(source).alias("b")).where("a = b")
    return only.groupBy(F.col("a").alias(source)).agg(F.count(F.lit(1)).alias("exclusive"))


def global_counts(df: DataFrame, low: float, high: float, key: str = "key", value: str = "value") -> DataFrame:
    """Distinct keys and rows in range (A10)."""
    return df.agg(F.count_distinct(key).alias("keys"), F.count_if(F.col(value).between(low, high)).alias("in_range"))


def verify_output(df: DataFrame, key: str, value: str, split: str) -> DataFrame:
    """One row: NULLs by column, repeated keys, value range, rows by split."""
    nulls = F.struct(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return df.agg(F.count(F.lit(1)).alias("n"), (F.count(key) - F.count_distinct(key)).alias("repeated"), F.min(value).alias("low"), F.max(value).alias("high"),
                  F.count_if(F.col(split) == "train").alias("train"), F.count_if(F.col(split) == "test").alias("test"), nulls.alias("nulls"))


def completeness(df: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """Share of missing values by column family, and of rows without any."""
    def missing(c: str) -> Column:
        return (F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int")

    every = [c for columns in families.values() for c in columns]
    rates = [F.avg(sum((missing(c) for c in cs), F.lit(0)) / len(cs)).alias(name) for name, cs in families.items()]
    return df.agg(*rates, F.avg((sum((missing(c) for c in every), F.lit(0)) == 0).cast("int")).alias("complete_rows"))


def profile_table(df: DataFrame, value: str, key_token: str = "key", value_token: str = "value", first: int = 0, order: list[str] | None = None) -> DataFrame:
    """Row count, columns, candidate key and value columns, and rows whose value parses by its first part (S10). With ``first`` also that
    many rows as JSON, the first ones by ``order``."""
    part = F.split(F.split(F.col(value).cast("string"), " ")[0], "-")[0]
    def named(token: str) -> Column:
        return F.lit([c for c in df.columns if token in c.lower()] or [""])

    out = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(part.try_cast("double").isNotNull()).alias("parsed")).select(
        "n", "parsed", F.lit(",".join(df.columns)).alias("columns"), F.array_join(named(key_token), ",").alias("key_columns"), F.array_join(named(value_token), ",").alias("value_columns"))
    if not first:
        return out
    order = order or df.columns
    rows = head(df, first, *order).agg(F.array_sort(F.collect_list(F.struct(*order, F.to_json(F.struct(*df.columns)).alias("__j")))).alias("__r"))  # ``first`` rows
    return out.join(F.broadcast(rows.select(F.col("__r.__j").alias("first_rows"))))


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first rows by an explicit order (W10): a top-k, so no full sort."""
    return df.orderBy(*order).limit(n)
