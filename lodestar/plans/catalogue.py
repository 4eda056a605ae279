"""The registered queries of the retrieval engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans import maintenance, retrieval


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: keyword and vector hits, fused by rank."""
    return retrieval.hybrid_search(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return retrieval.QUERIES | maintenance.QUERIES


def oracle_sql() -> dict[str, str]:
    return retrieval.SQL | maintenance.SQL
