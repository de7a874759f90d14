"""Regression metrics, intervals and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import join_quantiles, quantiles, quantiles_of_counts, value_counts


def regression_metrics(df: DataFrame, y: str, yhat: str, by: list[str] | None = None, percent: bool = True) -> DataFrame:
    """n, r2, mae, rmse, mape by group in one aggregate (A12). r2 is 0 where y does not vary; mape skips \\|y\\| <= 1e-10."""
    e = F.col(yhat) - F.col(y)
    g = df.groupBy(*(by or [])).agg(F.count(e).alias("n"), F.var_pop(y).alias("__v"), F.avg(e * e).alias("__m"), F.avg(F.abs(e)).alias("mae"),
                                    F.avg(F.when(F.abs(y) > 1e-10, F.abs(e / F.col(y)))).alias("__p"))
    r2 = F.when(F.col("__v") > 0, 1 - F.col("__m") / F.col("__v")).otherwise(0.0)
    return g.select(*(by or []), "n", r2.alias("r2"), "mae", F.sqrt("__m").alias("rmse"), (F.col("__p") * (100 if percent else 1)).alias("mape"))


def fold_summary(df: DataFrame, y: str, yhat: str, model: str = "model", fold: str = "fold") -> DataFrame:
    """By model: mean and population deviation of each metric over folds, the pooled metrics, and the best fold."""
    per = regression_metrics(df, y, yhat, [model, fold])
    names = ["r2", "mae", "rmse", "mape"]
    s = per.groupBy(model).agg(*(F.avg(m).alias(f"{m}_mean") for m in names), *(F.stddev_pop(m).alias(f"{m}_std") for m in names),
                               F.max_by(fold, F.struct("r2", -F.col(fold))).alias("best_fold"))
    pooled = regression_metrics(df, y, yhat, [model]).select(model, *(F.col(m).alias(f"{m}_all") for m in names))
    return s.join(pooled, model)


def interval_quality(df: DataFrame, y: str, low: str, high: str, by: list[str] | None = None) -> DataFrame:
    """Coverage, mean and median width, relative width, n."""
    by = by or []
    w = F.col(high) - F.col(low)
    g = df.groupBy(*by).agg(F.avg(F.col(y).between(F.col(low), F.col(high)).cast("int")).alias("coverage"), F.avg(w).alias("mean_width"),
                            F.avg(F.abs(y)).alias("__y"), F.count(F.lit(1)).alias("n"))
    g = join_quantiles(g, quantiles(df.select(*by, w.alias("__w")), "__w", [0.5], by), by)
    return g.withColumns({"median_width": F.col("__q")[0], "relative_width": F.col("mean_width") / F.col("__y")}).drop("__y", "__q")


def conformal_quantile(df: DataFrame, residual: Column, coverage: float, by: list[str] | None = None, name: str = "q", signed: bool = False) -> DataFrame:
    """The interpolated quantile of |residual| at min(ceil((n + 1) c) / n, 1) (A15); of the residual itself if ``signed``."""
    by = by or []
    r = df.select(*by, (residual if signed else F.abs(residual)).alias("__r")).where("__r is not null")
    counts = value_counts(r, "__r", by)
    g = counts.groupBy(*by).agg(F.sum("__n").alias("n")) if by else counts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"))
    level = F.least(F.ceil((F.col("__t") + 1) * F.lit(float(coverage))) / F.col("__t"), F.lit(1.0))
    return join_quantiles(g, quantiles_of_counts(counts, [level], by), by).select(*by, F.col("__q")[0].alias(name), "n")


def ensemble(df: DataFrame, key: str, yhat: str) -> DataFrame:
    """Mean and population deviation of member predictions."""
    return df.groupBy(key).agg(F.avg(yhat).alias("mean"), F.stddev_pop(yhat).alias("deviation"), F.count(yhat).alias("members"))


def group_importance(importance: DataFrame, groups: DataFrame) -> DataFrame:
    """importance (feature, value) by feature group (feature, grp): sum, mean, count."""
    return importance.join(groups, "feature").groupBy("grp").agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.count("value").alias("n"))


def composition(df: DataFrame, sequence: str, member: str, yhat: str) -> DataFrame:
    """Mean member prediction per sequence, and a confidence by its length."""
    n = F.count(member)
    tier = F.when(n <= 1, "HIGH").when(n <= 4, "MEDIUM").otherwise("LOW")
    return df.groupBy(sequence).agg(F.avg(yhat).alias("mean"), n.alias("length"), tier.alias("confidence"))


def constraint_summary(features: DataFrame, signs: DataFrame) -> DataFrame:
    """Features by sign of their constraint: positive, negative or unconstrained (A24). signs: feature, sign."""
    return constraints(features, signs).groupBy("constraint").agg(F.count(F.lit(1)).alias("n"))


def constraints(features: DataFrame, signs: DataFrame) -> DataFrame:
    """(feature, constraint) for each feature, in rows, so that no list of them grows in one task."""
    sign = F.when(F.col("sign") > 0, "positive").when(F.col("sign") < 0, "negative").otherwise("unconstrained")
    return features.join(signs, "feature", "left").select("feature", sign.alias("constraint"))


def leaderboard(df: DataFrame, name: str = "model", score: str = "r2_mean", order: str = "config_order") -> DataFrame:
    """Ranks by score and the difference to the first configured entry (W07). A table of entries, so one window is enough."""
    base = F.first_value(score).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("delta", F.col(score) - base).withColumn("rank", F.rank().over(Window.orderBy(F.desc(score))))


def cumulative_layers(df: DataFrame, key: str, layer: str, part: str, y: str) -> DataFrame:
    """Metrics after each layer of contributions."""
    running = F.sum(part).over(Window.partitionBy(key).orderBy(layer).rowsBetween(Window.unboundedPreceding, 0))
    return regression_metrics(df.withColumn("__c", running), y, "__c", [layer])


def top_k(df: DataFrame, score: str, k: int, *ties: str) -> DataFrame:
    """W06."""
    return df.orderBy(F.desc(score), *ties).limit(k)
