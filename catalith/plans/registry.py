"""All registered queries of the enrichment engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalith.plans import more_queries, part_queries, record_queries, registry_queries, run_queries, stage_queries, text_queries

PARTS = [registry_queries.QUERIES, text_queries.QUERIES, stage_queries.QUERIES, more_queries.QUERIES, record_queries.QUERIES, part_queries.QUERIES, run_queries.QUERIES]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry_queries.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for part in PARTS for name, (fn, _) in part.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, (_, sql) in part.items() if sql}
