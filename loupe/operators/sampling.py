"""Exact and stratified sampling that any engine can repeat: order by the md5 of an id and a seed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(identifier: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(identifier).cast("string"), F.lit(f"_{seed}")))


def ranked(df: DataFrame, group: list[str], order: list[Column | str], bucket: Column, name: str = "rank") -> DataFrame:
    """The place of each row in its group. bucket: some hundred values in the order of the first sorting column.

    Rows are numbered within a bucket, after the rows of the buckets before it, so a group of any size is spread over as many tasks as it has buckets.
    """
    x = df.withColumn("__bucket", bucket)
    sizes = x.groupBy(*group, "__bucket").agg(F.count("*").alias("__n"))
    # a row per group and bucket
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy(*group).orderBy("__bucket")) - F.col("__n")).drop("__n")
    before = before.withColumnsRenamed({c: f"__{c}" for c in group} | {"__bucket": "__b"})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group], F.col("__bucket").eqNullSafe(F.col("__b")))
    inner = F.row_number().over(Window.partitionBy(*group, "__bucket").orderBy(*order))
    joined = x.withColumn("__inner", inner).join(before, same)
    return joined.withColumn(name, F.col("__inner") + F.col("__before")).select(*df.columns, name)


def shuffled(df: DataFrame, identifier: str, seed: int = 42) -> DataFrame:
    """A column place: a seeded permutation of all rows."""
    x = df.withColumns({"__draw": draw(identifier, seed), "__all": F.lit(0)})
    return ranked(x, ["__all"], ["__draw", identifier], F.substring("__draw", 1, 2), "place").drop("__draw", "__all")


def exactly_per_group(df: DataFrame, group: str, identifier: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group; ValueError if a group is short."""
    # a row per group that is short
    short = [r[0] for r in df.groupBy(group).agg(F.count("*").alias("__n")).where(F.col("__n") < n).orderBy(group).limit(5).collect()]
    if short:
        raise ValueError(f"fewer than {n} rows: {short}")
    return per_group(df, group, identifier, n, seed)


def round_robin(df: DataFrame, group: str, identifier: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows: the groups take turns until each is empty. 0, or at least all rows, means all.

    Only the n smallest of (turn, group) are kept; groups are cut to n rows before the last step, which is a top-n.
    """
    if n <= 0:
        return df
    turn = F.row_number().over(Window.partitionBy(group).orderBy(draw(identifier, seed), identifier))
    return df.withColumn("__turn", turn).where(F.col("__turn") <= n).orderBy("__turn", group).limit(n).drop("__turn")


def per_group(df: DataFrame, group: str, identifier: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows of each group in drawn order."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(draw(identifier, seed), identifier))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def stratified_split(df: DataFrame, strata: list[str], identifier: str, share: float, seed: int = 42) -> DataFrame:
    """A column is_validation: the rounded share of each stratum."""
    x = ranked(df.withColumn("__draw", draw(identifier, seed)), strata, ["__draw", identifier], F.substring("__draw", 1, 2), "__rank")
    sizes = df.groupBy(*strata).agg(F.count("*").alias("__n")).withColumnsRenamed({c: f"__{c}" for c in strata})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in strata])
    return x.join(sizes, same).withColumn("is_validation", F.col("__rank") <= F.floor(F.col("__n") * share + 0.5)).select(*df.columns, "is_validation")
