"""Roll-ups, distributions and evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(F.coalesce(column, F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    # one row per value meets the total
    return counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("total")))).select("value", "n", F.round(F.col("n") * 100 / F.col("total"), 2).alias("percent"))


def distribution(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The keys with a map of value to count; null values are unknown."""
    counts = df.groupBy(*keys, F.coalesce(column, F.lit("unknown")).alias("__value")).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__value", "__n"))).alias("distribution"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Zero-filled contingency table over the given values, in one aggregation."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def top_values(df: DataFrame, keys: list[str], column: str, most: int) -> DataFrame:
    """The most frequent values of each key, ties by value."""
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), column))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most)


def lowest_per_group(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def entity_summary(df: DataFrame) -> DataFrame:
    """By domain and entity: rows, mean rating and shares of the labels; null keys stay a group."""
    share = lambda v: F.round(F.avg((F.col("label") == v).cast("double")) * 100, 2)
    return df.groupBy("domain", "entity_id").agg(
        F.min("entity_name").alias("entity_name"), F.count("*").alias("reviews"), F.round(F.avg("rating"), 2).alias("avg_rating"), F.min("rating").alias("min_rating"), F.max("rating").alias("max_rating"),
        share("negative").alias("negative_pct"), share("positive").alias("positive_pct"),
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * rows of the class)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", F.round(F.col("total") / (F.col("k") * F.col("n")), 6).alias("weight"))


def _label_scores(df: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """(label, tp, support, called, precision, recall, f1) from one aggregation of counts."""
    counts = df.agg(
        *[F.count_if((F.col(actual) == v) & (F.col(predicted) == v)).alias(f"tp_{i}") for i, v in enumerate(labels)],
        *[F.count_if(F.col(actual) == v).alias(f"a_{i}") for i, v in enumerate(labels)],
        *[F.count_if(F.col(predicted) == v).alias(f"p_{i}") for i, v in enumerate(labels)],
    )
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("label"), F.col(f"tp_{i}").alias("tp"), F.col(f"a_{i}").alias("support"), F.col(f"p_{i}").alias("called")) for i, v in enumerate(labels)]))
    part = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    x = counts.select(rows.alias("r")).select("r.*")
    return x.withColumns({"precision": part(F.col("tp"), F.col("called")), "recall": part(F.col("tp"), F.col("support")), "f1": part(2 * F.col("tp"), F.col("called") + F.col("support"))})


def precision_recall(df: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """Support, precision, recall and F1 of each label."""
    x = _label_scores(df, actual, predicted, labels)
    return x.select("label", "support", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


def overall(df: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """Accuracy, and the means of precision, recall and F1 over the labels, plain and weighted by support; macro_rounded_f1 is that of rounded values."""
    x = _label_scores(df, actual, predicted, labels)
    n = F.sum("support")
    macro = [F.round(F.avg(c), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    weighted = [F.round(F.sum(F.col(c) * F.col("support")) / n, 4).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    return x.agg(n.alias("n"), F.round(F.sum("tp") / n, 4).alias("accuracy"), *macro, F.round(F.avg(F.round("f1", 4)), 4).alias("macro_rounded_f1"), *weighted)


def whole_star(rating: Column) -> Column:
    """1 to 5, half to even."""
    return F.bround(F.least(F.lit(5.0), F.greatest(F.lit(1.0), rating))).cast("int")


def star_agreement(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Whole stars against each other: the overall scores, and how far apart they are."""
    gap = F.abs(F.col(actual) - F.col(predicted))
    rate = lambda c: F.round(F.avg(c.cast("double")), 4)
    apart = df.agg(rate(gap <= 1).alias("within_one"), F.round(F.avg(gap), 4).alias("mae"), rate(gap >= 3).alias("severe"), rate(gap == 4).alias("four_stars"))
    # one row each
    return apart.crossJoin(F.broadcast(overall(df, actual, predicted, [1, 2, 3, 4, 5])))


def means(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.round(F.avg(c), 2).alias(c) for c in columns])


def by_scale(counts: DataFrame, column: str, scale: list[str]) -> DataFrame:
    """A small table with its place on a scale; values that the scale doesn't have come last."""
    at = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in scale]), F.col(column)), F.lit(0))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.when(at == 0, len(scale) + 1).otherwise(at), column)))


def top_items(counts: DataFrame, label: str, n: str, most: int, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The labels with the greatest numbers above zero, without those excluded in any case; ties by label."""
    return counts.where(~F.lower(label).isin(*exclude) & (F.col(n) > 0)).orderBy(F.desc(n), label).limit(most)


def normal_distribution(as_map: DataFrame, as_list: DataFrame, as_text: DataFrame) -> DataFrame:
    """(label, n) of distributions d given as a map, as a list of (label, count) and as JSON of pairs; equal labels are added up."""
    first = as_map.select(F.explode("d").alias("label", "n"))
    second = as_list.select(F.inline("d")).toDF("label", "n")
    pairs = as_text.select(F.explode(F.from_json("d", "array<array<string>>")).alias("p"))
    third = pairs.select(F.col("p")[0].alias("label"), F.col("p")[1].try_cast("long").alias("n"))
    return first.unionByName(second).unionByName(third).groupBy("label").agg(F.sum("n").alias("n"))
