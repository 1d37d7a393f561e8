"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm.form_duplicates import collapse, repeats
from loupe.llm import sqlforms as Q
from loupe.session import table


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orchestrator_hotel_sample").select("row_ord", "entity_id", F.col("review_text").alias("text"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeats(_rows(spark, folder))


def p6_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct record with its number of copies."""
    return collapse(_rows(spark, folder))


QUERIES = {"p6_found": p6_found, "p6_collapsed": p6_collapsed}
_CANON = f"(SELECT row_ord, {Q.key('entity_id')} AS e, {Q.canonical('review_text')} AS w FROM {Q.SAMPLE} WHERE {Q.key('entity_id')} IS NOT NULL AND review_text IS NOT NULL)"
_KEPT = f"(SELECT row_ord, min(row_ord) OVER (PARTITION BY e, w) AS kept_row_ord FROM {_CANON} WHERE w <> '' AND {Q.count('w')} >= 4)"
SQL: dict[str, str] = {
    "p6_found": f"SELECT kept_row_ord, row_ord FROM {_KEPT} WHERE row_ord <> kept_row_ord",
    "p6_collapsed": f"SELECT kept_row_ord, count(*) AS copies FROM {_KEPT} GROUP BY 1",
}
