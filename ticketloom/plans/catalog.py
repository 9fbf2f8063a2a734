"""All registered queries, by operator id, with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import context_queries, kb_queries, label_queries, mining_queries, report_queries, retrieval_queries, stream_queries

_PARTS = (context_queries, kb_queries, label_queries, mining_queries, report_queries, retrieval_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for p in _PARTS for k, (q, _) in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for p in _PARTS for k, (_, sql) in p.QUERIES.items() if sql}
