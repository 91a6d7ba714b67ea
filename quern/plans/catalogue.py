"""All queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import capacity_queries, source_queries, stat_queries, text_queries
from quern.plans.standins import REGISTRY

MODULES = (capacity_queries, source_queries, stat_queries, text_queries)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The query of the driver's smoke check."""
    return text_queries.prevalence_by_language(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in REGISTRY.items()}


def oracles() -> dict[str, str]:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
