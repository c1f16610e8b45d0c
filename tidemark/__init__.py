"""Spark-native market-state analytics engine."""

from tidemark.session import get_session
from tidemark.tables import load_tables, table

__all__ = ["get_session", "load_tables", "table"]
