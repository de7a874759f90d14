"""Delimited files, all columns as text."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _scan(spark: SparkSession, path: str, sep: str, encoding: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", False).csv(path)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", columns: list[str] | None = None) -> DataFrame:
    """A headed CSV or TSV file as text columns.

    Read as UTF-8, a byte-order mark dropped; if any value fails to decode the whole file is read as Latin-1. A missing
    file is an empty table with ``columns``.
    """
    try:
        df = _scan(spark, path, sep, "UTF-8")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns or []]))
    broken = F.lit(False)
    for c in df.columns:
        broken = broken | F.coalesce(F.col(f"`{c}`").contains("�"), F.lit(False))
    if any("�" in c for c in df.columns) or df.where(broken).limit(1).count():
        df = _scan(spark, path, sep, "ISO-8859-1")
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def read_with_order(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``read_delimited`` with ``src_row``, a struct that sorts rows as they stand in their files."""
    df = read_delimited(spark, path, sep)
    if "_metadata" in df.columns or not df.columns:
        return df.withColumn("src_row", F.lit(None))
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return df.select("*", at.alias("src_row"))
