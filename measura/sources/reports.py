"""Report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    """Write a table as CSV with a header (flat tables) or as JSON lines (nested ones as well)."""
    writer = df.write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).csv(path)
    elif form == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown form {form}")
