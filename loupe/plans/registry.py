"""All queries of the core: name -> function of (session, folder of tables), and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("loupe.plans.review_queries", "loupe.plans.source_queries", "loupe.plans.issue_queries", "loupe.plans.shape_queries", "loupe.plans.scoring_queries", "loupe.plans.timestamp_queries")


def core_queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in import_module(m).QUERIES.items()}


def core_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(m).SQL.items()}
