"""New files of a folder, conformed and appended as they arrive.

The tables of this library are batch tables; the one incremental behaviour, skipping what is done, is here a stream over a folder
whose checkpoint remembers the files it has read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def append_new(spark: SparkSession, folder: str, schema: T.StructType, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame],
               key: str | None = None) -> None:
    """Read what is new in ``folder``, transform and append it to ``out``; with ``key``, keys that ``out`` holds are left out.

    Each micro-batch is written to a folder of its own, overwritten if the batch is repeated after a failure, so nothing is appended twice."""
    from ..sources.store import exists

    def write(batch: DataFrame, number: int) -> None:
        new = transform(batch)
        if key is not None:
            new = new.dropDuplicates([key])
            if exists(spark, out):
                done = spark.read.parquet(out).where(F.col("batch") != number).select(key)
                new = new.join(done, key, "left_anti")
        new.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(folder)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
