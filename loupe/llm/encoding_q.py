"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm.encoding import find_garbled
from loupe.session import table


def p7_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Garbled reviews with the restored text, the chains that were undone, and whether characters are lost."""
    return find_garbled(table(spark, folder, "orchestrator_hotel_sample").select("row_ord", F.col("review_text").alias("text")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_restored(spark, folder).select("row_ord")


QUERIES = {"p7_found": p7_found, "p7_restored": p7_restored}
SQL: dict[str, str] = {}
