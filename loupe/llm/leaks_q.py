"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm.leaks import find_leaks
from loupe.llm import sqlforms as Q
from loupe.session import table


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Every leak, exact or re-parameterised, with its length."""
    return find_leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_leaks(spark, folder).where("kind = 'exact'").select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per leaked item and kind: documents that hold it."""
    return p9_leaks(spark, folder).groupBy("item_id", "kind").agg(F.count("*").alias("documents"), F.max("words").alias("longest"))


QUERIES = {"p9_found": p9_found, "p9_leaks": p9_leaks, "p9_items": p9_items}
_RUN = lambda t, i, x: f"(SELECT DISTINCT {i}, array_to_string(w[k : k + 11], ' ') AS run FROM (SELECT {i}, w, unnest(generate_series(1, len(w) - 11)) AS k FROM (SELECT {i}, string_split({Q.words(x)}, ' ') AS w FROM {t} WHERE {x} IS NOT NULL) WHERE len(w) >= 12))"
SQL: dict[str, str] = {"p9_found": f"SELECT DISTINCT doc_id, item_id FROM {_RUN('documents', 'doc_id', 'text')} JOIN {_RUN('eval_items', 'item_id', 'item_text')} USING (run)"}
