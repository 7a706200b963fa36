"""Queries over the driver tables, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.plans import queries as q
from tracewright.plans import chain_queries, stage_queries  # noqa: F401  register their queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.flagship(spark, sf_dir)


def queries() -> dict:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(q.SQL)
