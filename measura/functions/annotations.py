"""Property strings ``base|key=value;key=value|``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = r"^(.*?)\|([^|]*)\|\s*$"


def base_of(text: Column) -> Column:
    """What stands before the block; the whole text without one."""
    return F.when(text.rlike(BLOCK), F.regexp_extract(text, BLOCK, 1)).otherwise(text)


def _pairs(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_extract(text, BLOCK, 2), ";"), F.trim), lambda x: x != "")


def _entries(text: Column) -> Column:
    good = F.filter(_pairs(text), lambda x: x.rlike(r"^\s*[^=\s][^=]*=."))
    return F.transform(good, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("k"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))


def properties(text: Column) -> Column:
    """map of lower-cased key to value; the last of equal keys wins, malformed pairs are ignored."""
    entries = _entries(text)
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def typed_properties(df: DataFrame, id_col: str, text_col: str, schema: DataFrame) -> DataFrame:
    """(id, name, text, number) for each property (F05). schema: alias, name, type. Of a
    float property the leading number counts, its unit is ignored; unknown keys keep their name."""
    long = df.select(id_col, F.explode(properties(F.col(text_col))).alias("alias", "text"))
    named = long.join(schema, "alias", "left")
    number = F.regexp_extract("text", r"^\s*([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")
    return named.select(id_col, F.coalesce("name", "alias").alias("name"), "text", F.when(F.col("type") == "float", number).alias("number"))


def render(base: Column, props: Column) -> Column:
    """The property string, keys in order; an empty map gives the base."""
    parts = F.transform(F.array_sort(F.map_entries(props)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.size(props) > 0, F.concat(base, F.lit("|"), F.array_join(parts, ";"), F.lit("|"))).otherwise(base)


def merged(old: Column, new: Column) -> Column:
    """Both maps in one; the later value wins."""
    lower = F.transform_keys(new, lambda k, v: F.lower(k))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(lower), k)), lower)


def errors(text: Column, floats: list[str]) -> Column:
    """The kinds of errors in a property string (F07), in order."""
    entries = _entries(text)
    keys = F.transform(entries, lambda x: x["k"])
    number = r"^\s*[-+]?[0-9]*\.?[0-9]+"
    kinds = F.array(
        F.when(F.trim(base_of(text)) == "", "empty_base"),
        F.when(F.size(entries) < F.size(_pairs(text)), "malformed_pair"),
        F.when(F.size(F.array_distinct(keys)) < F.size(keys), "duplicate_key"),
        F.when(F.exists(entries, lambda x: x["k"].isin(floats) & ~x["v"].rlike(number)), "not_a_number"))
    return F.filter(kinds, lambda x: x.isNotNull())


def kind_code(text: Column) -> Column:
    """1 for ``{...}``, 0 for plain keys, -1 for none; and the markers counted."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", -1).when(text.contains("{"), 1).otherwise(0)


def marker_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\[[<>$]\d*\]|\*"))
