"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
SPACE = r"[ \t-\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder that the cluster names in ``spark.checkpoint.dir``. Without one there is no folder that driver
    and executors are known to share, so nothing is written; only a session in local mode may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="measura-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors cost no rerun."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def checked_broadcast(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast a written table of narrow rows if it has at most ``most`` of them; else leave the join to a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote and nothing reads any more."""
    if path := getattr(df, "_scratch", None):
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        out.append(n)
    return out


def fold_of(id_col: str, k: int) -> Column:
    """crc32 of the id's text, modulo ``k``; rows without an id count as fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % k, F.lit(0)).cast("int")


def sample_share(df: DataFrame, id_col: str, share: float, most: int) -> DataFrame:
    """The ``most`` rows whose ids have the smallest hashes, the same ones every time; ``share`` is ``most`` by the number of rows.

    Half as many again are let through by hash before, so that no task has to pass on more."""
    order = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 30))
    if (some := 1.5 * share + 100 * share / max(1, most)) < 1:
        df = df.where(order < int(some * (1 << 30)))
    return df.orderBy(order, id_col, *(c for c in df.columns if c != id_col)).limit(most)


def by_bytes(column: pa.Array, most: int):
    """Cut an Arrow string array into runs of about ``most`` bytes, one row at least: (first, count)."""
    size = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    if not len(size):
        return
    part = np.cumsum(size) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(edges, edges[1:]):
        yield a, b - a


def words_of(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words between ASCII white space, no empty ones: the row of each word, and all words in order."""
    parts = pc.ascii_split_whitespace(column)
    rows = np.asarray(pc.list_parent_indices(parts))
    words = pc.list_flatten(parts)
    full = pc.greater(pc.binary_length(words), 0)
    return rows[np.asarray(full)], words.filter(full)
