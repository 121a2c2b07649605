"""All registered queries."""

from . import catalog_analytics, catalog_sources, catalog_streaming, catalog_tables  # noqa: F401
from .registry import QUERIES, oracle, run

__all__ = ["QUERIES", "oracle", "run"]
