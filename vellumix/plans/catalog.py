"""Collects the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import q_aggregate, q_more, q_relational, q_retrieval, q_scalar, q_sources  # noqa: F401  each module registers its queries
from .registry import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: lexical and near lists fused by rank, aggregated to groups."""
    return QUERIES["r05_hybrid_search"](spark, sf_dir)
