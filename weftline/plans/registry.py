"""All queries of the core library, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.plans import dedup_queries, pipeline_queries, record_queries, scalar_queries, score_queries, selection_queries, source_queries, stream_queries, text_queries, training_data, workflow_queries

FLAGSHIP = "p2_found"
_MODULES = (training_data, text_queries, dedup_queries, selection_queries, score_queries, record_queries, scalar_queries, pipeline_queries, source_queries, workflow_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
