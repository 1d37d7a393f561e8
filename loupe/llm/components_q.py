"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm.components import shares_of, split_related, tie_classes, ties
from loupe.llm import sqlforms as Q
from loupe.session import table


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orchestrator_hotel_sample").select("row_ord", "entity_id", F.col("review_text").alias("text"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return ties(_rows(spark, folder))


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    return split_related(_rows(spark, folder), shares_of(table(spark, folder, "split_shares")))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every text that ties entities: its component, how many entities it ties, and how many ties that makes."""
    return tie_classes(_rows(spark, folder)).select("component", "members", "links")


QUERIES = {"p1_found": p1_found, "p1_splits": p1_splits, "p1_classes": p1_classes}
SQL: dict[str, str] = {
    "p1_found": f"SELECT a AS entity_key_a, b AS entity_key_b FROM {Q.TIES}",
    "p1_classes": f"""
        WITH RECURSIVE e AS MATERIALIZED (SELECT a, b FROM {Q.TIES} UNION SELECT b, a FROM {Q.TIES}), r AS (SELECT a AS node, b AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
        c AS (SELECT node, least(node, min(reach)) AS component FROM r GROUP BY node)
        SELECT component, count(*) AS members, count(*) * (count(*) - 1) // 2 AS links FROM {Q.MEMBERS} JOIN c ON e = node GROUP BY w, component HAVING count(*) > 1
    """,
}
