"""Queries on inputs, canonical tables and further summaries, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loupe.functions import text as X
from loupe.operators import dedup, retrieval, summaries
from loupe.plans import review_queries as R
from loupe.session import table
from loupe.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


@query("txt_app_id", "SELECT row_ord, CASE WHEN regexp_matches(trim(coalesce(entity_id, '')), '^[A-Za-z][A-Za-z0-9_]*(\\.[A-Za-z][A-Za-z0-9_]*)+$') THEN trim(entity_id) END AS value FROM orchestrator_hotel_sample")
def _(s: SparkSession, d: str) -> DataFrame:
    return R.sample(s, d).select("row_ord", readers.app_id(F.col("entity_id")).alias("value"))


@query("std_input_detect", """SELECT row_ord, CASE WHEN lower(x) LIKE '%.csv' THEN 'csv' WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9_]*(\\.[A-Za-z][A-Za-z0-9_]*)+$') THEN 'app_id' ELSE 'text' END AS kind
    FROM (SELECT row_ord, trim(coalesce(entity_id, '')) AS x FROM orchestrator_hotel_sample)""")
def _(s: SparkSession, d: str) -> DataFrame:
    return R.sample(s, d).select("row_ord", readers.input_kind(F.col("entity_id")).alias("kind"))


@query("txt_fingerprint", "SELECT row_ord, sha256(concat_ws('|', coalesce(entity_id, ''), coalesce(review_id, ''), coalesce(rating_original, ''), coalesce(review_date, ''), coalesce(review_text, ''))) AS value FROM orchestrator_hotel_sample")
def _(s: SparkSession, d: str) -> DataFrame:
    parts = [F.coalesce(c, F.lit("")) for c in ("entity_id", "review_id", "rating_original", "review_date", "review_text")]
    return R.sample(s, d).select("row_ord", F.sha2(F.concat_ws("|", *parts), 256).alias("value"))


@query("txt_safe_filename", "SELECT row_ord, substring(trim(regexp_replace(coalesce(entity_name, ''), '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), 1, 100) AS value FROM orchestrator_hotel_sample")
def _(s: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_replace(F.coalesce("entity_name", F.lit("")), r"[^A-Za-z0-9_.-]+", "_")
    return R.sample(s, d).select("row_ord", F.substring(F.btrim(bare, F.lit("_")), 1, 100).alias("value"))


@query("src_csv_eval", "SELECT row_ord, coalesce(review_text, '') AS review_text, coalesce(rating, 0) AS rating FROM orchestrator_hotel_sample")
def _(s: SparkSession, d: str) -> DataFrame:
    return R.sample(s, d).select("row_ord", "review_text", "rating").na.fill("", ["review_text"]).na.fill(0.0, ["rating"])


# ---- canonical build of one source: label by rating, quality filter, conflicts out, first of each text

_MOBILE = f"""(SELECT *, md5({R.q_clean(R.q_markup('content'))}) AS k, {R.q_markup('content')} AS t, CASE WHEN score <= 2 THEN 'negative' WHEN score = 3 THEN 'neutral' WHEN score >= 4 THEN 'positive' END AS label FROM mobile_app_raw)"""


def mobile(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "mobile_app_raw")
    x = x.withColumns({"k": X.text_key(F.col("content")), "t": X.without_markup(F.col("content")), "label": X.strict_rating_label(F.col("score"))})
    return x.where(F.col("score").between(1, 5) & F.col("label").isNotNull() & (F.col("t") != "") & (X.word_count(F.col("t")) >= 4))


_MOBILE_GOOD = f"(SELECT * FROM {_MOBILE} WHERE score BETWEEN 1 AND 5 AND label IS NOT NULL AND t <> '' AND {R.q_words('t')} >= 4)"


@query("build_mobile", f"SELECT k, label, review_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY review_id) AS rn, min(label) OVER (PARTITION BY k) AS lo, max(label) OVER (PARTITION BY k) AS hi FROM {_MOBILE_GOOD}) WHERE rn = 1 AND lo = hi")
def _(s: SparkSession, d: str) -> DataFrame:
    return dedup.without_conflicts(mobile(s, d).select("k", "label", "review_id"), "k", "label", "review_id")


_SIDES = f"""(SELECT *, {R.q_says('negative_review', X.NEGATIVE_PLACEHOLDERS)} AND nw >= 4 AS nv, {R.q_says('positive_review', X.POSITIVE_PLACEHOLDERS)} AND pw >= 4 AS pv FROM (
    SELECT *, CAST({R.q_words('n')} AS INTEGER) AS nw, CAST({R.q_words('p')} AS INTEGER) AS pw FROM (
        SELECT *, reviewer_score AS sc, {R.q_markup('negative_review')} AS n, {R.q_markup('positive_review')} AS p FROM hotel_raw)))"""
_EVEN = "nv AND pv AND sc BETWEEN 5.5 AND 7.5 AND nw * 2 >= pw AND nw <= pw * 2"


def sides(s: SparkSession, d: str) -> DataFrame:
    """Both sides of the hotel reviews, cleaned, whether each is valid, and whether they are even."""
    x = table(s, d, "hotel_raw").withColumns({"sc": F.col("reviewer_score"), "n": X.without_markup(F.col("negative_review")), "p": X.without_markup(F.col("positive_review"))})
    x = x.withColumns({"nw": X.word_count(F.col("n")), "pw": X.word_count(F.col("p"))})
    x = x.withColumns({"nv": X.says_something(F.col("negative_review"), X.NEGATIVE_PLACEHOLDERS) & (F.col("nw") >= 4), "pv": X.says_something(F.col("positive_review"), X.POSITIVE_PLACEHOLDERS) & (F.col("pw") >= 4)})
    return x.withColumn("even", F.expr(_EVEN))


@query("build_hotel", f"""SELECT hotel_name, label, CASE label WHEN 'negative' THEN n WHEN 'positive' THEN p ELSE trim(n || ' ' || p) END AS sentiment_text FROM (
    SELECT hotel_name, n, p, CASE WHEN nv AND sc <= 5 THEN 'negative' WHEN pv AND sc >= 8 THEN 'positive' WHEN {_EVEN} THEN 'neutral' END AS label FROM {_SIDES}) WHERE label IS NOT NULL""")
def _(s: SparkSession, d: str) -> DataFrame:
    """The label of a hotel review by score and by which sides are valid, and the text that it stands for."""
    label = F.when(F.col("nv") & (F.col("sc") <= 5), "negative").when(F.col("pv") & (F.col("sc") >= 8), "positive").when(F.col("even"), "neutral")
    text = F.when(F.col("label") == "negative", F.col("n")).when(F.col("label") == "positive", F.col("p")).otherwise(F.btrim(F.concat_ws(" ", "n", "p")))
    return sides(s, d).withColumn("label", label).where("label IS NOT NULL").select("hotel_name", "label", text.alias("sentiment_text"))


@query("build_hotel_training", f"""WITH x AS (SELECT * FROM {_SIDES}), f AS (
    SELECT hotel_name, 'negative' AS label, n AS review_text, 'Negative_Review' AS text_source, sc / 2 AS rating FROM x WHERE nv AND sc <= 5
    UNION ALL SELECT hotel_name, 'neutral', trim(n || ' ' || p), 'Negative_Review + Positive_Review', sc / 2 FROM x WHERE {_EVEN}
    UNION ALL SELECT hotel_name, 'positive', p, 'Positive_Review', sc / 2 FROM x WHERE pv AND sc >= 8)
    SELECT {R.q_key('review_text')} AS text_key, min(label) AS label, count(*) AS copies FROM f GROUP BY 1 HAVING min(label) = max(label)""")
def _(s: SparkSession, d: str) -> DataFrame:
    """A row per label and side, not per review: the three frames together, texts of two labels out, equal texts once."""
    x = sides(s, d)
    frame = lambda cond, label, text: x.where(cond).select(F.lit(label).alias("label"), text.alias("review_text"))
    every = frame("nv AND sc <= 5", "negative", F.col("n")).unionByName(frame("even", "neutral", F.btrim(F.concat_ws(" ", "n", "p")))).unionByName(frame("pv AND sc >= 8", "positive", F.col("p")))
    keyed = every.groupBy(X.text_key(F.col("review_text")).alias("text_key")).agg(F.min("label").alias("label"), F.max("label").alias("most"), F.count("*").alias("copies"))
    return keyed.where("label = most").select("text_key", "label", "copies")


# ---- further summaries


@query("agg_fallback_entity", "SELECT domain, entity_name, count(*) AS n, round(avg(rating), 2) AS avg_rating FROM orchestrator_hotel_sample GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    return R.sample(s, d).groupBy("domain", "entity_name").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 2).alias("avg_rating"))


@query("agg_rate", f"SELECT source, round(avg(CASE WHEN {R.q_domain('domain')} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 2) AS unknown_pct FROM orchestrator_hotel_sample GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return R.sample(s, d).groupBy("source").agg(F.round(F.avg(X.known_domain(F.col("domain")).isNull().cast("double")) * 100, 2).alias("unknown_pct"))


@query("dash_distribution_norm", "SELECT lower(trim(domain)) AS label, count(*) AS n FROM orchestrator_hotel_sample WHERE domain IS NOT NULL GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    """Distributions in three forms (a map, a list of labels and counts, pairs as text) as one: equal labels are added up."""
    x = R.sample(s, d).where("domain IS NOT NULL").select("row_ord", F.lower(F.trim("domain")).alias("label"))
    part = lambda k: x.where(F.col("row_ord") % 3 == k).groupBy("label").agg(F.count("*").alias("n"))
    as_map = part(0).agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("d"))
    as_list = part(1).agg(F.collect_list(F.struct("label", F.col("n").alias("count"))).alias("d"))
    as_text = part(2).agg(F.to_json(F.collect_list(F.array("label", F.col("n").cast("string")))).alias("d"))
    return summaries.normal_distribution(as_map, as_list, as_text)


@query("agg_dashboard_dist", "SELECT source AS label, count(*) AS n FROM orchestrator_hotel_sample WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, label LIMIT 8")
def _(s: SparkSession, d: str) -> DataFrame:
    return R.sample(s, d).where("source IS NOT NULL").groupBy(F.col("source").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(8)


@query("ord_riskiest_entity", "SELECT row_ord, entity_id, rating FROM orchestrator_hotel_sample WHERE entity_id = (SELECT entity_id FROM orchestrator_hotel_sample WHERE entity_id IS NOT NULL AND rating IS NOT NULL GROUP BY 1 HAVING count(*) >= 5 ORDER BY avg(rating), entity_id LIMIT 1) ORDER BY rating NULLS LAST, row_ord LIMIT 8")
def _(s: SparkSession, d: str) -> DataFrame:
    """The entity with the lowest mean rating, and its eight lowest reviews."""
    x = R.sample(s, d).select("row_ord", "entity_id", "rating")
    means = x.where("entity_id IS NOT NULL AND rating IS NOT NULL").groupBy("entity_id").agg(F.avg("rating").alias("m"), F.count("*").alias("n")).where("n >= 5")
    worst = means.orderBy("m", "entity_id").limit(1).select("entity_id")
    return x.join(F.broadcast(worst), "entity_id", "left_semi").orderBy(F.asc_nulls_last("rating"), "row_ord").limit(8).select("row_ord", "entity_id", "rating")


@query("ret_build_corpus", f"SELECT domain, count(*) AS texts, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT {R.q_domain('domain')} AS domain, sha256({R.q_normal('review_text')}) AS h, count(*) AS n FROM orchestrator_hotel_sample WHERE {R.q_squeeze('review_text')} <> '' GROUP BY 1, 2) WHERE domain IS NOT NULL GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    x = R.sample(s, d).where(X.squeeze(F.col("review_text")) != "").select(X.known_domain(F.col("domain")).alias("domain"), X.text_hash(F.col("review_text")).alias("h"))
    texts = x.where("domain IS NOT NULL").groupBy("domain", "h").agg(F.count("*").alias("n"))
    return texts.groupBy("domain").agg(F.count("*").alias("texts"), F.sum("n").alias("rows"))


_PAIR = "(SELECT vec_id, label % 4 AS g, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query("num_dot", f"SELECT a.vec_id, round(list_dot_product(a.v, b.v), 4) AS value FROM {_PAIR} a JOIN {_PAIR} b ON b.vec_id = a.vec_id + 1")
def _(s: SparkSession, d: str) -> DataFrame:
    """The product of each vector with the next one."""
    v = table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return v.join(after, "vec_id").select("vec_id", F.round(retrieval.dot(F.col("v"), F.col("w")), 4).alias("value"))


@query("join_retrieval_theta", f"SELECT q.vec_id AS q_id, count(*) AS n, round(max(list_dot_product(q.v, c.v)), 4) AS best FROM {_PAIR} q JOIN {_PAIR} c ON q.g = c.g AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    """Every query (ids divisible by 50) against all rows of its group but itself: how many there are, and the best product."""
    v = table(s, d, "embeddings").select("vec_id", (F.col("label") % 4).alias("g"), F.col("embedding").alias("v"))
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "g", F.col("v").alias("w"))
    pairs = q.join(v, "g").where("q_id <> vec_id")
    return pairs.groupBy("q_id").agg(F.count("*").alias("n"), F.round(F.max(retrieval.dot(F.col("v"), F.col("w"))), 4).alias("best"))


@query("win_candidate_pool", f"SELECT q_id, c_id, place FROM (SELECT q.vec_id AS q_id, c.vec_id AS c_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, c.v), 4) DESC, c.vec_id) AS place FROM {_PAIR} q JOIN {_PAIR} c ON q.g = c.g WHERE q.vec_id % 50 = 0) WHERE place <= 80")
def _(s: SparkSession, d: str) -> DataFrame:
    """The eighty likeliest rows of a query's group, itself among them, before anything is ranked again or left out."""
    v = table(s, d, "embeddings").select("vec_id", (F.col("label") % 4).alias("g"), F.col("embedding").alias("vec"))
    return retrieval.candidate_pool(v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "q_id"), v.withColumnRenamed("vec_id", "c_id"), "g", 80).select("q_id", "c_id", "place")


@query("lbl_hotel", f"""SELECT coalesce(label, 'none') AS label, count(*) AS n FROM (SELECT CASE WHEN nv AND sc <= 5 THEN 'negative' WHEN pv AND sc >= 8 THEN 'positive' WHEN {_EVEN} THEN 'neutral' END AS label FROM {_SIDES}) GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    """How many hotel reviews get which label, and how many get none."""
    label = F.when(F.col("nv") & (F.col("sc") <= 5), "negative").when(F.col("pv") & (F.col("sc") >= 8), "positive").when(F.col("even"), "neutral").otherwise("none")
    return sides(s, d).groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("num_mean_pct", "SELECT source, round(avg(CASE WHEN rating >= 4 THEN 1.0 ELSE 0.0 END) * 100, 2) AS good_pct FROM orchestrator_hotel_sample WHERE rating IS NOT NULL GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return R.sample(s, d).where("rating IS NOT NULL").groupBy("source").agg(F.round(F.avg((F.col("rating") >= 4).cast("double")) * 100, 2).alias("good_pct"))


@query("agg_top_values", "SELECT * FROM (SELECT app_id, review_created_version, count(*) AS n, row_number() OVER (PARTITION BY app_id ORDER BY count(*) DESC, review_created_version) AS rank FROM mobile_app_raw WHERE review_created_version IS NOT NULL GROUP BY 1, 2) WHERE rank <= 5")
def _(s: SparkSession, d: str) -> DataFrame:
    return summaries.top_values(table(s, d, "mobile_app_raw").where("review_created_version IS NOT NULL"), ["app_id"], "review_created_version", 5)
