"""Queries over the shared tables, one per operator, with SQL equivalents."""

from . import detail_queries, listing_queries, nested_queries, run_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
