"""All registered queries of the chain operators, and their SQL."""

from __future__ import annotations

from .plans import storequeries
from .plans.queries import ORACLE, QUERIES

assert storequeries.QUERY_MODULE
__all__ = ["ORACLE", "QUERIES"]
