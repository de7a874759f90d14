"""Pluggable featurisers and work that resumes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def featurize(df: DataFrame, key: str, names: list[str], vector: Callable[[str], list[float]]) -> DataFrame:
    """(key, names..., error): the features of each key (U01). A failure gives NULL features and its message."""
    schema = T.StructType([df.schema[key], *(T.StructField(n, T.DoubleType()) for n in names), T.StructField("error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k in frame[key]:
                try:
                    got = list(vector(k))
                    if len(got) != len(names):
                        raise ValueError(f"{len(got)} values for {len(names)} names")
                    rows.append([k, *got, None])
                except Exception as e:  # whatever a plugged-in function raises belongs in the error column
                    rows.append([k, *[None] * len(names), f"{type(e).__name__}: {e}"])
            yield pd.DataFrame(rows, columns=[key, *names, "error"])

    return df.select(key).mapInPandas(run, schema)


def skipped(features: DataFrame) -> DataFrame:
    return features.agg(F.count(F.lit(1)).alias("rows"), F.count("error").alias("skipped"))


def incremental_apply(spark: SparkSession, df: DataFrame, key: str, done_path: str, fn: Callable[[DataFrame], DataFrame], schema: T.StructType) -> DataFrame:
    """Apply ``fn`` to the rows whose key ``done_path`` does not hold, append its results there, and return all results without
    failures (a NULL in every column but the key) (S09). What a stopped run has written is not computed again."""
    from ..sources.store import exists

    done = spark.read.schema(schema).parquet(done_path) if exists(spark, done_path) else spark.createDataFrame([], schema)
    fn(df.join(done.select(key), key, "left_anti")).select(*schema.names).write.mode("append").parquet(done_path)
    every = spark.read.schema(schema).parquet(done_path)
    return every.na.drop("all", subset=[c for c in schema.names if c != key])
