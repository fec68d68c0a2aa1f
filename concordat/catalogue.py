"""All registered queries of the evidence engine, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from concordat.plans import queries_displays, queries_documents, queries_history, queries_metrics, queries_places, queries_review, queries_scope, queries_sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (queries_metrics, queries_displays, queries_documents, queries_history, queries_places, queries_review, queries_scope, queries_sources):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
