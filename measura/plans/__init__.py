"""Query plans over the driver's tables."""

from . import features, tables, training  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
