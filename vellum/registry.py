"""Queries and oracle SQL of the library, without those of the subpackage for training data."""

from __future__ import annotations

from .plans import flow_queries, intake_queries, inventory_queries, layout_queries, navigation_queries, page_queries, review_queries, text_queries  # noqa: F401
from .plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
