"""Named queries over the driver's tables: QUERIES has the DataFrame form, ORACLE_SQL the DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import eval_queries, list_queries, section_queries, source_queries, text_queries

_MODULES = (list_queries, eval_queries, text_queries, section_queries, source_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
FLAGSHIP = "normalize_list_documents"
