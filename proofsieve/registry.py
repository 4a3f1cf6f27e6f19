"""All registered queries of the library, outside the folder ``llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proofsieve.plans import evaluation_queries, grounding_queries, ingest_queries, search_queries, streaming_queries

MODULES = [search_queries, ingest_queries, grounding_queries, evaluation_queries, streaming_queries]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in MODULES for k, s in m.SQL.items()}
