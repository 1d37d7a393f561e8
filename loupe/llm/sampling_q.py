"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loupe.llm.sampling import balanced_sample
from loupe.session import table


def _run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "build_multidomain_dataset").select("row_ord", "domain", "sentiment_label")
    return balanced_sample(rows, table(spark, folder, "sample_targets"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _run(spark, folder)[1].where("unmet").select("domain", "sentiment_label")


def p3_sample(spark: SparkSession, folder: str) -> DataFrame:
    return _run(spark, folder)[0]


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and drawn rows of each cell, and what is left between them."""
    return _run(spark, folder)[1]


QUERIES = {"p3_found": p3_found, "p3_sample": p3_sample, "p3_report": p3_report}
_CELLS = """
        WITH s AS (
            SELECT CASE WHEN d IN ('hotel','hotels','hot') THEN 'hotel' WHEN d IN ('ecommerce','ecommerces','eco','ecom') THEN 'ecommerce'
                        WHEN d IN ('mobileapp','mobileapps','mob') THEN 'mobile_app' WHEN d IN ('restaurant','restaurants','res') THEN 'restaurant' END AS domain,
                   CASE WHEN l IN ('positive','positives','pos') THEN 'positive' WHEN l IN ('negative','negatives','neg') THEN 'negative'
                        WHEN l IN ('neutral','neutrals','neu') THEN 'neutral' END AS sentiment_label
            FROM (SELECT regexp_replace(regexp_replace(lower(domain), '[\\s\\p{Z}_\\-]+', '', 'g'), '\\.+$', '') AS d,
                         regexp_replace(regexp_replace(lower(sentiment_label), '[\\s\\p{Z}_\\-]+', '', 'g'), '\\.+$', '') AS l FROM build_multidomain_dataset)
        ), k AS (SELECT * FROM s WHERE domain IS NOT NULL AND sentiment_label IS NOT NULL),
        n AS (SELECT count(*) // 10 AS n FROM k),
        c AS (SELECT domain, sentiment_label, count(*) AS have FROM k GROUP BY 1, 2)
"""
SQL: dict[str, str] = {
    "p3_found": _CELLS
    + """
        SELECT t.domain, t.sentiment_label FROM sample_targets t CROSS JOIN n LEFT JOIN c USING (domain, sentiment_label)
        WHERE coalesce(have, 0) * 100 < t.target_pct * n OR coalesce(have, 0) < t.min_rows
    """
}
