"""Every query over the test tables and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessionlake.plans import browsing, filing, indexing, searching

FLAGSHIP = "hybrid_search"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = searching.QUERIES | browsing.QUERIES | indexing.QUERIES | filing.QUERIES
ORACLE_SQL: dict[str, str] = searching.ORACLE_SQL | browsing.ORACLE_SQL | indexing.ORACLE_SQL | filing.ORACLE_SQL
