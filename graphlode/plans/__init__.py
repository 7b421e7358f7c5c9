"""Registered queries: importing this package fills the registry."""

from . import graph_queries, result_queries, search_queries, nssg_queries, source_queries  # noqa: F401
