"""Exact nearest neighbours by inner product within a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which the corpus rows of a group are divided, as a group may hold most of them.
PARTS = 32


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    length = F.sqrt(dot(v, v))
    return F.when(length == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / length))


def _place(keys: list[str], *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def candidate_pool(queries: DataFrame, corpus: DataFrame, group: str, pool: int) -> DataFrame:
    """The `pool` corpus rows of the same group with the greatest product, for each query, with score and place; ties by c_id.

    queries: q_id, group, vec and others; corpus: c_id, group, vec and others, whose names begin with c_ in the result. The queries are a stated
    set, so this is a join on the group; each query meets the group's corpus rows in PARTS parts, and the best of each part meet again.
    """
    named = corpus.withColumnsRenamed({c: f"c_{c}" for c in corpus.columns if c not in ("c_id", group)}).withColumn("__part", F.pmod(F.xxhash64("c_id"), F.lit(PARTS)).cast("int"))
    asked = queries.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    scored = asked.join(named, [group, "__part"]).withColumn("score", F.round(dot(F.col("vec"), F.col("c_vec")), 4))
    best = scored.withColumn("__place", _place(["q_id", "__part"], F.desc("score"), "c_id")).where(F.col("__place") <= pool).drop("__place", "__part")
    return best.withColumn("place", _place(["q_id"], F.desc("score"), "c_id")).where(F.col("place") <= pool)


def _once(fit: DataFrame, k: int) -> DataFrame:
    """Of equal hashes the best counts; the k best of what is left, with their rank."""
    once = fit.withColumn("__again", _place(["q_id", "c_hash"], F.desc("score"), "c_id")).where(F.col("__again") == 1)
    return once.withColumn("rank", _place(["q_id"], F.desc("score"), "c_id")).where(F.col("rank") <= k)


def top_evidence(queries: DataFrame, corpus: DataFrame, group: str, k: int = 3, pool: int = 80, least: float = 0.0) -> DataFrame:
    """The k best corpus rows of the same group for each query row, after a pool of the best `pool`; never itself, never an equal hash.

    queries: q_id, group, hash, vec. corpus: c_id, group, hash, vec.
    """
    pooled = candidate_pool(queries, corpus, group, pool)
    fit = pooled.where((F.col("c_id") != F.col("q_id")) & (F.col("hash") != F.col("c_hash")) & (F.col("score") >= least))
    return _once(fit, k).select("q_id", "c_id", "score", "rank")


def ranked_evidence(queries: DataFrame, corpus: DataFrame, issues: DataFrame, group: str, k: int = 3, pool: int = 80, least: float = 0.30, weight: float = 0.10) -> DataFrame:
    """The k best corpus rows of the same group, ranked by the review's likeness and, with `weight`, by that of its issue.

    queries: q_id, group, label, hash, entity, vec. corpus: c_id, group, hash, entity, vec. issues: group, issue_vec, a row per group. The pool is
    taken by the review's likeness alone. Never itself, an equal hash or the same entity; of equal hashes the best counts.
    """
    pooled = candidate_pool(queries, corpus, group, pool).join(F.broadcast(issues), group).withColumnRenamed("score", "own")
    exact = (1 - weight) * dot(F.col("vec"), F.col("c_vec")) + weight * dot(F.col("c_vec"), F.col("issue_vec"))
    x = pooled.withColumn("score", F.round(exact, 4))
    fit = x.where((F.col("c_id") != F.col("q_id")) & (F.col("hash") != F.col("c_hash")) & (F.col("entity") != F.col("c_entity")) & (F.col("score") >= least))
    return _once(fit, k).select("q_id", "label", "c_id", "c_hash", "score", "own", "rank")


def bucketed(evidence: DataFrame, key: str, most: int) -> DataFrame:
    """Of each key the first `most` pieces of evidence with different hashes, in the order of query and rank; the place in the bucket is added."""
    first = evidence.groupBy(key, "c_hash").agg(F.min(F.struct("q_id", "rank", "c_id")).alias("r")).select(key, "c_hash", "r.*")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("q_id", "rank"))).where(F.col("place") <= most)
