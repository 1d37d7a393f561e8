"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm.caps import cap_contributors, over_cap
from loupe.session import table


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orchestrator_hotel_sample").select("row_ord", "domain", "entity_id", F.col("review_text").alias("text"), "rating")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return over_cap(_rows(spark, folder), table(spark, folder, "entity_caps")).select("domain", "entity_key")


def p2_capped(spark: SparkSession, folder: str) -> DataFrame:
    """The sample's reviews with every entity within its cap."""
    return cap_contributors(_rows(spark, folder), table(spark, folder, "entity_caps")).select("row_ord", "domain", "entity_id", "rating")


QUERIES = {"p2_found": p2_found, "p2_capped": p2_capped}
_SCORE = r"""round(0.5 * least(len(list_filter(regexp_split_to_array(coalesce(review_text, ''), '[\s\x0B]+'), lambda w: w <> '')), 120) / 120 + CASE WHEN rating BETWEEN 1 AND 5 THEN 0.25 ELSE 0.0 END
    + 0.25 * CASE WHEN letters > 0 THEN 1 - capitals / letters ELSE 0.0 END, 6)"""
SQL: dict[str, str] = {
    "p2_capped": rf"""
        WITH s AS (
            SELECT *, CASE WHEN d IN ('hotel','hotels','hot') THEN 'hotel' WHEN d IN ('ecommerce','ecommerces','eco','ecom') THEN 'ecommerce'
                        WHEN d IN ('mobileapp','mobileapps','mob') THEN 'mobile_app' WHEN d IN ('restaurant','restaurants','res') THEN 'restaurant' END AS dom,
                   nullif(trim(regexp_replace(lower(entity_id), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '') AS e, length(regexp_replace(coalesce(review_text, ''), '[^\p{{L}}]+', '', 'g')) AS letters,
                   length(regexp_replace(coalesce(review_text, ''), '[^\p{{Lu}}]+', '', 'g')) AS capitals
            FROM (SELECT *, regexp_replace(regexp_replace(lower(domain), '[\s\p{{Z}}_\-]+', '', 'g'), '\.+$', '') AS d FROM orchestrator_hotel_sample)
        ), t AS (SELECT c.domain AS dom, count(*) * max_pct // 100 AS cap FROM s JOIN entity_caps c ON s.dom = c.domain WHERE e IS NOT NULL GROUP BY 1, max_pct),
        k AS (SELECT s.*, cap, row_number() OVER (PARTITION BY s.dom, e ORDER BY {_SCORE} DESC, row_ord) AS place FROM s LEFT JOIN t ON s.dom = t.dom AND e IS NOT NULL)
        SELECT row_ord, domain, entity_id, rating FROM k WHERE cap IS NULL OR place <= cap
    """,
    "p2_found": """
        WITH s AS (
            SELECT CASE WHEN d IN ('hotel','hotels','hot') THEN 'hotel' WHEN d IN ('ecommerce','ecommerces','eco','ecom') THEN 'ecommerce'
                        WHEN d IN ('mobileapp','mobileapps','mob') THEN 'mobile_app' WHEN d IN ('restaurant','restaurants','res') THEN 'restaurant' END AS domain,
                   nullif(trim(regexp_replace(lower(entity_id), '[^\\p{L}\\p{N}]+', ' ', 'g')), '') AS entity_key
            FROM (SELECT regexp_replace(regexp_replace(lower(domain), '[\\s\\p{Z}_\\-]+', '', 'g'), '\\.+$', '') AS d, entity_id FROM orchestrator_hotel_sample)
        ), k AS (SELECT * FROM s WHERE domain IS NOT NULL AND entity_key IS NOT NULL),
        t AS (SELECT domain, count(*) AS total FROM k GROUP BY 1),
        e AS (SELECT domain, entity_key, count(*) AS n FROM k GROUP BY 1, 2)
        SELECT e.domain, e.entity_key FROM e JOIN t USING (domain) JOIN entity_caps c USING (domain) WHERE e.n * 100 > c.max_pct * t.total
    """
}
