"""Key and value expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_key(key: Column) -> Column:
    """Trimmed, each bare ``*`` in brackets."""
    return F.regexp_replace(F.trim(key), r"(?<!\[)\*(?!\])", "[*]")


def plain_key(key: Column) -> Column:
    """The inverse: bracketed stars bare again."""
    return F.regexp_replace(key, r"\[\*\]", "*")


def canonical_key(key: Column, canonicalizer: Callable[[Column], Column] = normalize_key) -> Column:
    """The canonical form, or the raw key where there is none."""
    return F.coalesce(canonicalizer(key), key)


def is_valid_key(key: Column, canonicalizer: Callable[[Column], Column] = normalize_key) -> Column:
    return canonicalizer(key).isNotNull()


def has_marker(key: Column) -> Column:
    """P03."""
    return F.coalesce(key.contains("*"), F.lit(False))


def over_precise(text: Column, digits: int = 2) -> Column:
    """More decimals than ``digits`` once trailing zeros are gone; false for what is no number."""
    decimals = F.length(F.regexp_extract(F.regexp_replace(F.trim(text), r"(\.\d*?)0+$", "$1"), r"\.(\d+)$", 1))
    return F.coalesce(text.try_cast("double").isNotNull() & (decimals > digits), F.lit(False))


def first_reason(reasons: dict[str, Column]) -> Column:
    """The first reason that holds, NULL if none."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(reasons.items()):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def to_kelvin(value: Column, below: float | None = None) -> Column:
    """Celsius to Kelvin; with ``below`` only values under it are taken for Celsius."""
    return value + 273.15 if below is None else F.when(value < below, value + 273.15).otherwise(value)


def is_mixture(ratio: Column, second: Column, default: float = 100.0) -> Column:
    """A ratio under 100 and a second key that is neither empty nor the filler ``C``."""
    share = F.coalesce(ratio.try_cast("double"), F.lit(default))
    return (share < 100) & F.coalesce((F.trim(second) != "") & (second != "C"), F.lit(False))


def label_or(name: Column, source: Column, number: Column) -> Column:
    """The name, or ``source_n`` without one."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat(source, F.lit("_"), number.cast("string")))


def clip(value: Column, low: float, high: float) -> Column:
    """P13; NULL stays NULL."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def guarded_ratio(part: Column, whole: Column) -> Column:
    """part / max(whole, 1)."""
    return part / F.greatest(whole, F.lit(1))
