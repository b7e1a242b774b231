"""All queries of the core library, by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstore.plans import integrity, retrieval_queries, store_queries, stream_queries, text_queries

_MODULES = (integrity, store_queries, retrieval_queries, text_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.SQL.items()}
