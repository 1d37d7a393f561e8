"""Scorers behind one interface: text in, label and confidence, distribution or vector out.

A scorer is any function from a DataFrame with id and text to one with id and its outputs, so a neural model can stand in where a
linear one over hashed words is trained here. Training and scoring stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.functions.text import clean_text
from loupe.operators.summaries import class_weights

FEATURES = 1 << 14

Scorer = Callable[[DataFrame], DataFrame]


def _words(width: int) -> list:
    return [RegexTokenizer(inputCol="__text", outputCol="__words", pattern=" ", toLowercase=False), HashingTF(inputCol="__words", outputCol="__counts", numFeatures=width), Normalizer(inputCol="__counts", outputCol="features")]


def _with_text(df: DataFrame) -> DataFrame:
    return df.withColumn("__text", clean_text(F.col("text")))


def train_labels(df: DataFrame, seed_rounds: int = 30) -> tuple[PipelineModel, list[str]]:
    """A model of the labels of df (text, label) and the labels in its order; each class weighs the same. Rows without a label are left out."""
    x = _with_text(df.where("label IS NOT NULL").withColumn("label", F.col("label").cast("string")))
    # a row per label
    weights = class_weights(x, "label").select("label", "weight")
    x = x.join(F.broadcast(weights), "label")
    indexer = StringIndexer(inputCol="label", outputCol="__target", stringOrderType="alphabetAsc")
    model = Pipeline(stages=[indexer, *_words(FEATURES), LogisticRegression(labelCol="__target", weightCol="weight", probabilityCol="__p", maxIter=seed_rounds, regParam=0.01)]).fit(x)
    return model, list(model.stages[0].labels)


def label_scorer(model: PipelineModel, labels: list[str]) -> Scorer:
    """id, label, confidence: the likeliest label and its probability, which is also in distribution (in the labels' order)."""
    scoring = PipelineModel(model.stages[1:])

    def score(df: DataFrame) -> DataFrame:
        p = vector_to_array("__p")
        x = scoring.transform(_with_text(df.select("id", "text"))).select("id", p.alias("distribution"))
        best = F.array_max("distribution")
        names = F.array(*[F.lit(v) for v in labels])
        return x.select("id", F.element_at(names, F.array_position("distribution", best).cast("int")).alias("label"), best.alias("confidence"), "distribution")

    return score


def vector_scorer(width: int = 256) -> Scorer:
    """id, vec: a unit vector of hashed words; texts without words give zeros."""

    def score(df: DataFrame) -> DataFrame:
        pipeline = PipelineModel([*_words(width)])
        return pipeline.transform(_with_text(df.select("id", "text"))).select("id", vector_to_array("features", "float32").alias("vec"))

    return score


@dataclass
class Registry:
    """Scorers by name. A strict one refuses to stand in for a scorer that it doesn't have."""

    strict: bool = True
    scorers: dict[str, Scorer] = field(default_factory=dict)

    def add(self, name: str, scorer: Scorer) -> None:
        self.scorers[name] = scorer

    def missing(self, wanted: list[str]) -> list[str]:
        return sorted(set(wanted) - set(self.scorers))

    def get(self, name: str, fallback: Scorer | None = None) -> Scorer:
        if name in self.scorers:
            return self.scorers[name]
        if self.strict or fallback is None:
            raise KeyError(f"no scorer is registered as {name!r}")
        return fallback
