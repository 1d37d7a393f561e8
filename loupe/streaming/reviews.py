"""The row-wise operators under Structured Streaming, with the stateful ones bounded by watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.functions.text import clean_text, rating_label, safe_rating


def scored(stream: DataFrame) -> DataFrame:
    """Stateless: cleaned text and label of each review."""
    return stream.withColumns({"clean": clean_text(F.col("content")), "label": rating_label(safe_rating(F.col("score")))})


def distinct_within(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Repeats of a key are dropped as long as they come within the delay; state older than that is let go."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def label_windows(stream: DataFrame, time: str, width: str, delay: str) -> DataFrame:
    """Reviews and mean rating of each window and label; late rows beyond the delay are left out."""
    x = scored(stream).withWatermark(time, delay)
    return x.groupBy(F.window(time, width), "label").agg(F.count("*").alias("n"), F.avg(safe_rating(F.col("score"))).alias("avg_rating"))
