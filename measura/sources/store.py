"""Parquet stores: the unified table, and results computed once."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder that the cluster names; in local mode a temporary folder where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="measura-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows, written once to the shared folder: what is read many times is not computed again."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_unified(df: DataFrame, path: str, split: str = "split") -> None:
    """The unified table, a folder for each split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_unified(spark: SparkSession, path: str, value: str | None = None, split: str = "split") -> DataFrame:
    """All of the unified table, or one split of it by partition pruning."""
    df = spark.read.parquet(path)
    return df if value is None else df.where(F.col(split) == value)


def materialize_once(spark: SparkSession, make: Callable[[], DataFrame], root: str, spec: str, version: str) -> DataFrame:
    """Load what was computed for this spec and input version before, else compute and write it."""
    path = f"{root}/{hashlib.sha256(f'{spec} {version}'.encode()).hexdigest()[:16]}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
