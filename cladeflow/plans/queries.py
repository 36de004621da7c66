"""All queries of the library outside the training-data operators."""

from __future__ import annotations

from . import further_queries, order_queries, sequence_queries, statistics_queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
