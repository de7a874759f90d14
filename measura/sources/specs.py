"""Declarative source specs: one description per source instead of one loader per source."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Column_:
    """A target column: the first of ``names`` that the source has, cast to ``type``; rows without it go if ``required``."""

    names: tuple[str, ...]
    type: str = "string"
    required: bool = False
    convert: Callable[[Column], Column] | None = None
    default: object = None


@dataclass(frozen=True)
class SourceSpec:
    name: str
    priority: int
    columns: dict[str, Column_]
    constants: dict[str, object] = field(default_factory=dict)
    keep: Callable[[DataFrame], Column] | None = None


def resolve_column(df: DataFrame, token: str) -> str | None:
    """The first header that contains ``token``, upper and lower case alike."""
    return next((c for c in df.columns if token.lower() in c.lower()), None)


def conform(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """Rename, pick alternatives, cast and filter a raw table (S02). Values that do not cast are NULL; required ones drop the row.
    The result also has ``source`` and ``priority``."""
    out = {}
    for target, c in spec.columns.items():
        have = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in c.names if n in df.columns]
        value = F.coalesce(*have) if have else F.lit(None).cast("string")
        value = value.try_cast(c.type)
        value = c.convert(value) if c.convert else value
        out[target] = value if c.default is None else F.coalesce(value, F.lit(c.default).cast(c.type))
    raw = df.where(spec.keep(df)) if spec.keep else df
    rest = [c for c in ("src_row",) if c in df.columns]
    got = raw.select(*(v.alias(k) for k, v in out.items()), *(F.lit(v).alias(k) for k, v in spec.constants.items()),
                     F.lit(spec.name).alias("source"), F.lit(spec.priority).alias("priority"), *rest)
    for target, c in spec.columns.items():
        if c.required:
            got = got.where(F.col(target).isNotNull())
    return got


def load_all(tables: dict[str, DataFrame], specs: Iterable[SourceSpec], names: list[str] | None = None, value: str = "value",
             low: float | None = None, high: float | None = None, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """The union of conformed sources (S04). ``names`` picks sources, unknown ones are skipped; without it all but ``leave_out``
    are taken. Values outside [low, high] go before anything else looks at them."""
    chosen = [s for s in specs if s.name in tables and (s.name in names if names is not None else s.name not in leave_out)]
    if not chosen:
        raise ValueError("no known source")
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (conform(tables[s.name], s) for s in chosen))
    if low is not None or high is not None:
        df = df.where(F.col(value).between(F.lit(low if low is not None else float("-inf")), F.lit(high if high is not None else float("inf"))))
    return df
