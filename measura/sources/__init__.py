"""Reading, conforming and writing tables."""

from .delimited import read_delimited, read_with_order
from .reports import write_report
from .specs import Column_, SourceSpec, conform, load_all, resolve_column
from .store import materialize_once, read_unified, scratch, write_unified

__all__ = ["read_delimited", "read_with_order", "write_report", "Column_", "SourceSpec", "conform", "load_all", "resolve_column",
           "materialize_once", "read_unified", "scratch", "write_unified"]
