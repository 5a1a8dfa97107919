"""Named queries over the driver's tables, each with the equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graniteloom.plans import curating, deciding, diffing, evaluating, feeds, grading, matching, ruling, streams
from graniteloom.plans.curating import curate_split

__all__ = ["curate_split", "oracle_sql", "queries"]
MODULES = (curating, deciding, diffing, evaluating, feeds, grading, matching, ruling, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
