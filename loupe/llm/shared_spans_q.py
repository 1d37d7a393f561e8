"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loupe.llm.shared_spans import shared_coverage, shared_intervals
from loupe.session import table


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_intervals(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id").distinct()


def p10_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Of each document that shares long spans, how much of it is shared."""
    return shared_coverage(table(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {"p10_found": p10_found, "p10_coverage": p10_coverage}
_WINDOWS = "(SELECT doc_id, i, hash(substring(text, i, 200)) AS h, length(text) AS n_chars FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 199)) AS i FROM documents WHERE length(text) >= 200))"
#: Windows of 200 characters that another document has too.
_SHARED = f"(SELECT DISTINCT w.doc_id, i, n_chars FROM {_WINDOWS} w JOIN (SELECT h FROM {_WINDOWS} GROUP BY h HAVING min(doc_id) <> max(doc_id)) USING (h))"
SQL: dict[str, str] = {
    "p10_found": f"SELECT DISTINCT doc_id FROM {_SHARED}",
    "p10_coverage": f"""
        SELECT doc_id, n_chars, CAST(n AS INTEGER) AS shared_chars, round(n / n_chars, 6) AS share, CAST(spans AS INTEGER) AS spans FROM (
            SELECT doc_id, n_chars, sum(least(200, coalesce(next - i, 200))) AS n, count(*) FILTER (next IS NULL OR next - i > 200) AS spans
            FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM {_SHARED}) GROUP BY 1, 2)
    """,
}
