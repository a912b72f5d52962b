"""Registered queries and their SQL."""

from . import graph_queries, store_queries, stream_queries, vector_queries, write_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
