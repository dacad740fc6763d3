"""All queries of the engine by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import code_kernels, codebase, kernels, sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = kernels.QUERIES
assert code_kernels.query is codebase.query is sources.query is kernels.query  # they add to the same table
ORACLE: dict[str, str] = dict(kernels.ORACLE)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next(iter(QUERIES.values()))(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE
