"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackweave.plans import diagnostics, files, images, refine, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return diagnostics.QUERIES | refine.QUERIES | files.QUERIES | images.QUERIES


def oracle_sql() -> dict[str, str]:
    return sql.SQL | files.SQL | images.SQL
