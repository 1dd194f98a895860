"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import core_queries, extract_queries, graph_queries, page_queries, search_queries, site_queries, snapshot_queries, stream_queries, text_queries, version_queries

PARTS = (core_queries, search_queries, snapshot_queries, version_queries, text_queries, extract_queries, graph_queries, page_queries, site_queries, stream_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for part in PARTS for name, q in part.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for part in PARTS for name, sql in part.ORACLE.items()}
