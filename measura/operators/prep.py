"""Preparation fitted on training rows only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles


@dataclass
class Scaler:
    """Training mean and population deviation, floored at 1e-10."""

    mean: dict[str, float]
    std: dict[str, float]

    @staticmethod
    def fit(train: DataFrame, columns: list[str]) -> Scaler:
        row = train.agg(*(F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(columns))).first()
        return Scaler({c: row[f"m{k}"] or 0.0 for k, c in enumerate(columns)}, {c: max(row[f"s{k}"] or 0.0, 1e-10) for k, c in enumerate(columns)})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - self.mean[c]) / self.std[c] for c in self.mean})


def yeo_johnson(x: Column, power: Column) -> Column:
    up = F.when(F.abs(power) < 1e-9, F.log1p(x)).otherwise((F.pow(x + 1, power) - 1) / power)
    down = F.when(F.abs(power - 2) < 1e-9, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - power) - 1) / (2 - power))
    return F.when(x >= 0, up).otherwise(down)


@dataclass
class PowerScaler:
    """Yeo-Johnson powers by likelihood, then min-max scaling."""

    power: dict[str, float]
    low: dict[str, float]
    high: dict[str, float]

    @staticmethod
    def fit(train: DataFrame, columns: list[str]) -> PowerScaler:
        """One aggregate by column and power evaluates a grid of powers; a second one a finer grid around each column's best.
        Columns without values keep power 1."""
        long = train.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "c", "x").where("x is not null")
        p, x = F.col("p"), F.col("x")
        best = dict.fromkeys(columns, 1.0)
        grids = {c: np.arange(-2, 4.01, 0.5) for c in columns}
        for width in (0.5, 0.1):
            powers = F.create_map(*(v for c in columns for v in (F.lit(c), F.lit([float(g) for g in grids[c]]))))
            tried = long.withColumn("p", F.explode(powers[F.col("c")])).groupBy("c", "p").agg(
                F.first(p - 1).alias("q"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("s"), F.count(x).alias("n"), F.var_pop(yeo_johnson(x, p)).alias("v"))
            likelihood = F.col("q") * F.col("s") - F.col("n") / 2 * F.log(F.greatest("v", F.lit(1e-300)))
            # a row for each column; the smaller power of equally likely ones
            best |= {r.c: r.p for r in tried.groupBy("c").agg(F.max_by("p", F.struct(likelihood, -p)).alias("p")).collect()}
            grids = {c: np.arange(best[c] - width, best[c] + width + 1e-9, width / 5) for c in columns}
        return PowerScaler.at(train, best)

    @staticmethod
    def at(train: DataFrame, power: dict[str, float]) -> PowerScaler:
        """Given powers; the ends come from the training rows, one aggregate."""
        columns = list(power)
        ends = train.agg(*(f(yeo_johnson(F.col(c), F.lit(power[c]))).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max)))).first()
        return PowerScaler(power, {c: ends[f"a{k}"] or 0.0 for k, c in enumerate(columns)}, {c: ends[f"b{k}"] or 0.0 for k, c in enumerate(columns)})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (yeo_johnson(F.col(c), F.lit(p)) - self.low[c]) / max(self.high[c] - self.low[c], 1e-10) for c, p in self.power.items()})


def medians(train: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact training medians, 0 for columns without values."""
    long = train.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "feature", "x")
    found = {r.feature: r["__q"][0] for r in quantiles(long, "x", [0.5], ["feature"]).collect()}  # a number for each column
    return {c: float(found.get(c, 0.0)) for c in columns}


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.na.fill(values)


@dataclass
class Components:
    model: PCAModel
    columns: list[str]
    explained: list[float]

    @staticmethod
    def fit(train: DataFrame, columns: list[str], k: int) -> Components:
        """PCA of the complete training rows (M17); no more components than rows."""
        ready = VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="skip").transform(train)
        k = max(1, min(k, len(columns), ready.limit(k + 1).count()))
        model = PCA(k=k, inputCol="__v", outputCol="__pc").fit(ready)
        return Components(model, columns, [float(x) for x in model.explainedVariance])

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        """Incomplete rows get NULLs."""
        whole = F.lit(True)
        for c in self.columns:
            whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        filled = VectorAssembler(inputCols=[f"__{c}" for c in self.columns], outputCol="__v").transform(df.withColumns({f"__{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in self.columns}))
        out = self.model.transform(filled).withColumn("__a", vector_to_array("__pc"))
        out = out.withColumns({f"{prefix}{i}": F.when(whole, F.col("__a")[i]) for i in range(len(self.explained))})
        return out.drop("__v", "__pc", "__a", *(f"__{c}" for c in self.columns))
