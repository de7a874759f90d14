"""Symbol sequences (F09, F10, U02) and hashed n-grams."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, NGram
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of an alphabet that every task may hold.
MOST_UNITS = 10_000


def clean(sequence: Column) -> Column:
    """Upper case; an end tag in front and one behind, 3' or 5' with a hyphen or space, gone (F09). White space inside stays a bad symbol."""
    bare = F.regexp_replace(F.upper(F.regexp_replace(sequence, r"^\s+|\s+$", "")), r"^[35]'[- ]?", "")
    return F.regexp_replace(bare, r"[- ]?[35]'$", "")


def first_bad(sequence: Column, alphabet: str) -> Column:
    """Position of the first symbol outside the alphabet, 0 if all are inside."""
    return F.regexp_instr(sequence, F.lit(f"[^{alphabet}]"))


def expand(df: DataFrame, id_col: str, sequence_col: str, units: DataFrame, reverse: bool = False) -> DataFrame:
    """(id, position, symbol, unit), one row for each symbol (F10, U02). units: symbol, inner, last.

    An alphabet's units are counted: up to ``MOST_UNITS`` every task holds them, as symbols are too few to be dealt over tasks; beyond, they shuffle."""
    if len(units.take(MOST_UNITS + 1)) <= MOST_UNITS:
        units = F.broadcast(units)
    text = F.reverse(F.col(sequence_col)) if reverse else F.col(sequence_col)
    long = df.select(id_col, F.length(sequence_col).alias("__n"), F.posexplode(F.split(text, "")).alias("position", "symbol")).where("symbol <> ''")
    end = F.col("position") == F.col("__n") - 1
    return long.join(units, "symbol").select(id_col, "position", "symbol", F.when(end, F.col("last")).otherwise(F.col("inner")).alias("unit"))


def translate_sequence(sequence: Column, inner: dict[str, str], last: dict[str, str], reverse: bool = False) -> Column:
    """The units of a sequence in one string, without leaving the row; NULL if a symbol is unknown."""
    symbols = F.filter(F.split(F.reverse(sequence) if reverse else sequence, ""), lambda x: x != "")

    def pick(table: dict[str, str], x: Column) -> Column:
        out = F.lit(None).cast("string")
        for symbol, unit in table.items():
            out = F.when(x == symbol, unit).otherwise(out)
        return out

    units = F.transform(symbols, lambda x, i: F.when(i == F.size(symbols) - 1, pick(last, x)).otherwise(pick(inner, x)))
    return F.when(~F.exists(units, lambda x: x.isNull()), F.array_join(units, ""))


def hashed_ngrams(df: DataFrame, text_col: str, out: str, n: int = 3, size: int = 1024, binary: bool = True) -> DataFrame:
    """A hashed n-gram fingerprint of the characters of a text."""
    letters = df.withColumn("__c", F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), ""), lambda x: x != ""))
    grams = NGram(n=n, inputCol="__c", outputCol="__g").transform(letters)
    return HashingTF(numFeatures=size, binary=binary, inputCol="__g", outputCol=out).transform(grams).drop("__c", "__g")
