"""Queries on trained scorers and on stored runs, corpora and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.functions import text as X
from loupe.operators import issues, sampling, scoring, standardise, summaries
from loupe.plans import review_queries as R
from loupe.session import scratch
from loupe.sources import writers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def _labelled_texts(s: SparkSession, d: str) -> DataFrame:
    return R.canon(s, d).select(F.col("row_ord").alias("id"), F.col("review_text").alias("text"), X.known_label(F.col("sentiment_label")).alias("label"), "rating").where("text IS NOT NULL")


@query("mdl_train_sentiment")
def _(s: SparkSession, d: str) -> DataFrame:
    """A model of the supplied labels, trained on four rows of five and judged on the fifth."""
    x = _labelled_texts(s, d).where("label IS NOT NULL")
    held = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    model, labels = scoring.train_labels(x.where(~held))
    judged = scoring.label_scorer(model, labels)(x.where(held)).select("id", F.col("label").alias("predicted")).join(x.select("id", F.col("label").alias("actual")), "id")
    return summaries.overall(judged, "actual", "predicted", list(X.LABELS))


@query("mdl_sentiment")
def _(s: SparkSession, d: str) -> DataFrame:
    """Label and confidence of each review of the sample, by a model of the other table's labels."""
    model, labels = scoring.train_labels(_labelled_texts(s, d))
    scored = scoring.label_scorer(model, labels)(R.sample(s, d).select(F.col("row_ord").alias("id"), F.col("review_text").alias("text")))
    return scored.select(F.col("id").alias("row_ord"), F.col("label").alias("predicted_sentiment"), F.round("confidence", 4).alias("sentiment_confidence"))


@query("mdl_train_star")
def _(s: SparkSession, d: str) -> DataFrame:
    """A model of whole stars, judged on held-out rows: exact, within one, apart."""
    x = _labelled_texts(s, d).where("rating IS NOT NULL").select("id", "text", summaries.whole_star(F.col("rating")).cast("string").alias("label"))
    held = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    model, labels = scoring.train_labels(x.where(~held))
    judged = scoring.label_scorer(model, labels)(x.where(held)).select("id", F.col("label").cast("int").alias("predicted")).join(x.select("id", F.col("label").cast("int").alias("actual")), "id")
    return summaries.star_agreement(judged, "actual", "predicted")


@query("mdl_star")
def _(s: SparkSession, d: str) -> DataFrame:
    """Likeliest and mean star of each review of the sample."""
    x = _labelled_texts(s, d).where("rating IS NOT NULL").select("id", "text", summaries.whole_star(F.col("rating")).cast("string").alias("label"))
    model, labels = scoring.train_labels(x)
    scored = scoring.label_scorer(model, labels)(R.sample(s, d).select(F.col("row_ord").alias("id"), F.col("review_text").alias("text")))
    mean = X.total(F.zip_with("distribution", F.array(*[F.lit(float(v)) for v in labels]), lambda p, star: p * star))
    return scored.select(F.col("id").alias("row_ord"), F.col("label").cast("int").alias("predicted_star_rating"), F.round("confidence", 4).alias("star_confidence"), F.round(mean, 4).alias("expected_star"))


@query("mdl_embed", "SELECT row_ord, 256 AS width FROM orchestrator_hotel_sample")
def _(s: SparkSession, d: str) -> DataFrame:
    """A vector of fixed width for each review."""
    vectors = scoring.vector_scorer()(R.sample(s, d).select(F.col("row_ord").alias("id"), F.col("review_text").alias("text")))
    return vectors.select(F.col("id").alias("row_ord"), F.size("vec").alias("width"))


@query("mdl_registry", "SELECT 'embed' AS name, true AS present UNION ALL SELECT 'sentiment', false UNION ALL SELECT 'star', false")
def _(s: SparkSession, d: str) -> DataFrame:
    """Which of the wanted scorers are at hand."""
    registry = scoring.Registry()
    registry.add("embed", scoring.vector_scorer())
    wanted = ["embed", "sentiment", "star"]
    absent = registry.missing(wanted)
    return s.createDataFrame([(n, n not in absent) for n in wanted], "name string, present boolean")


# ---- inputs and outputs of runs


@query("src_hf_sample", f"SELECT row_ord, entity_id, review_text, rating FROM {R.CANON} ORDER BY md5(CAST(row_ord AS VARCHAR) || '_42'), row_ord LIMIT 500")
def _(s: SparkSession, d: str) -> DataFrame:
    """A seeded draw of fixed size with the wanted columns."""
    return R.canon(s, d).select("row_ord", "entity_id", "review_text", "rating").orderBy(sampling.draw("row_ord", 42), "row_ord").limit(500)


@query("src_corpus_cached", f"SELECT {R.q_domain('domain')} AS domain, count(DISTINCT sha256({R.q_normal('review_text')})) AS texts, 'built,kept,built' AS history FROM {R.SAMPLE} WHERE {R.q_domain('domain')} IS NOT NULL AND {R.q_squeeze('review_text')} <> '' GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    """A corpus that is built once, read as long as its source's signature stays, and built anew when that changes."""
    x = R.sample(s, d).select(X.known_domain(F.col("domain")).alias("domain"), X.squeeze(R.T()).alias("text"), X.text_hash(R.T()).alias("text_hash")).where("domain IS NOT NULL AND text <> ''")
    corpus = lambda: x.groupBy("domain", "text_hash").agg(F.min("text").alias("text"))
    folder, history = scratch(s), []
    for signature in ("one", "one", "two"):
        kept, built = writers.load_or_build(s, folder, signature, corpus)
        history.append("built" if built else "kept")
    return kept.groupBy("domain").agg(F.count("*").alias("texts")).withColumn("history", F.lit(",".join(history)))


@query("snk_index", f"SELECT {R.q_domain('domain')} AS domain, count(*) AS n FROM {R.SAMPLE} WHERE {R.q_domain('domain')} IS NOT NULL AND review_text IS NOT NULL GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    """Vectors in a folder per domain with a manifest, read again by domain."""
    x = R.sample(s, d).select(F.col("row_ord").alias("id"), X.known_domain(F.col("domain")).alias("domain"), F.col("review_text").alias("text")).where("domain IS NOT NULL AND text IS NOT NULL")
    folder = scratch(s)
    writers.write_table(scoring.vector_scorer(64)(x).join(x.select("id", "domain"), "id"), f"{folder}/vectors", partition_by="domain")
    return s.read.parquet(f"{folder}/vectors").groupBy("domain").agg(F.count("*").alias("n"))


@query("snk_pipeline", f"""SELECT 'entities' AS name, count(*) AS n FROM ({R._ENTITY}) UNION ALL SELECT 'examples', (SELECT count(DISTINCT entity_id) FROM {R.SAMPLE} WHERE {R.q_squeeze('review_text')} <> '') + (SELECT count(*) FROM (SELECT 1 FROM {R.SAMPLE} WHERE entity_id IS NULL AND {R.q_squeeze('review_text')} <> '' LIMIT 1))
    UNION ALL SELECT 'issues', count(*) FROM {R.SAMPLE} UNION ALL SELECT 'reviews', (SELECT count(*) FROM ({R.SQL['std_standard_passthrough']}))""")
def _(s: SparkSession, d: str) -> DataFrame:
    """The tables of a whole run (reviews, issues, entities, examples) with their manifest and trace, read again."""
    tables = {
        "reviews": standardise.already_common(R.sample(s, d).where("rating_original IS NOT NULL")), "issues": issues.mine(R.sample(s, d), issues.default_taxonomy(s)),
        "entities": summaries.entity_summary(R.labelled(s, d)), "examples": R.QUERIES["agg_evidence_examples"](s, d),
    }
    folder = scratch(s)
    writers.write_run(tables, f"{folder}/run", {"trace": ["standardise", "issues", "entities", "examples"]})
    named = writers.read_manifest(s, f"{folder}/run")["tables"]
    counts = [s.read.parquet(f"{folder}/run/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in named]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("snk_prepared", f"SELECT count(*) AS n, sum(rating) AS ratings FROM ({R.SQL['std_standard_passthrough']})")
def _(s: SparkSession, d: str) -> DataFrame:
    """The standardised table as CSV, written over an older one, read again."""
    folder = scratch(s)
    x = standardise.already_common(R.sample(s, d).where("rating_original IS NOT NULL")).select("row_ord", "domain", "rating")
    for _ in range(2):
        writers.write_table(x, folder, kind="csv")
    return s.read.option("header", True).schema("row_ord long, domain string, rating double").csv(folder).agg(F.count("*").alias("n"), F.sum("rating").alias("ratings"))


@query("snk_state", "SELECT 'done' AS status, 3 AS steps")
def _(s: SparkSession, d: str) -> DataFrame:
    """The state of a run as JSON, the last one written counts."""
    folder = scratch(s)
    for status, steps in (("running", 1), ("done", 3)):
        writers.write_state(s, folder, {"status": status, "steps": steps})
    state = writers.read_state(s, folder)
    return s.createDataFrame([(state["status"], state["steps"])], "status string, steps int")


@query("src_subprocess_bridge", "SELECT * FROM (VALUES ('good', ''), ('without rows', 'the table is empty'), ('without text', 'missing columns: review_text')) v(name, fault)")
def _(s: SparkSession, d: str) -> DataFrame:
    """What a collector delivered, held against its contract: the wanted columns, and rows."""
    good = R.sample(s, d).select("review_id", "review_text", "rating")
    cases = {"good": good, "without text": good.drop("review_text"), "without rows": good.where("false")}
    return s.createDataFrame([(n, writers.contract_fault(df, ["review_id", "review_text", "rating"])) for n, df in cases.items()], "name string, fault string")
