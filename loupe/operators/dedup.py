"""Duplicates and conflicts by key, with input order deciding ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of every key in the order of a unique column. Aggregates before the shuffle, so a hot key costs no more."""
    others = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(order)).alias("__row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def without_conflicts(df: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """Keys that carry more than one label go whole; of the others the first row stays."""
    others = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min(label).alias("__lo"), F.max(label).alias("__hi"), F.min_by(F.struct(*others), F.col(order)).alias("__row"))
    picked = picked.where(F.col("__lo").isNull() | (F.col("__lo") == F.col("__hi")))
    return picked.select(*[F.col(c) if c == key else F.col(f"__row.{c}").alias(c) for c in df.columns])


def conflict_audit(df: DataFrame, key: str, label: str) -> DataFrame:
    """Input rows, conflicting keys and rows, repeated rows, rows that stay."""
    keys = df.groupBy(key).agg(F.count("*").alias("n"), (F.min(label) != F.max(label)).alias("bad"))
    bad = F.coalesce("bad", F.lit(False))
    return keys.agg(
        F.sum("n").alias("input_rows"), F.sum(bad.cast("long")).alias("conflicting_keys"), F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("conflicting_rows"),
        F.sum(F.when(bad, 0).otherwise(F.col("n") - 1)).alias("duplicate_rows"), F.sum(F.when(bad, 0).otherwise(1)).alias("output_rows"),
    )


def keys_across(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that occur in more than one group."""
    return df.groupBy(key).agg(F.min(group).alias("lo"), F.max(group).alias("hi"), F.count_distinct(group).alias("n")).where("lo <> hi").select(key, F.col("n").alias("groups"))
