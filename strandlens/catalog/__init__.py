"""All registered queries and their check SQL."""

from . import joins, rows, sequences, series  # noqa: F401  (they register on import)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
