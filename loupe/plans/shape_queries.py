"""Queries on source shapes, files and streams, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loupe.functions import text as X
from loupe.operators import dedup, standardise, summaries
from loupe.plans import review_queries as R
from loupe.session import scratch, table
from loupe.sources import readers, writers
from loupe.streaming import reviews as streaming

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


# ---- products and meals as raw tables: views of the sample's rows of these domains

_SHOP = f"(SELECT row_ord, rating_original AS rating, entity_name AS title, review_text AS text, entity_id AS asin, CASE WHEN row_ord % 2 = 0 THEN entity_id END AS parent_asin, review_date AS timestamp FROM {R.SAMPLE} WHERE {R.q_domain('domain')} = 'ecommerce')"
_MEALS = f"(SELECT row_ord, entity_id AS url, rating_original AS rating, review_date, review_text FROM {R.SAMPLE} WHERE {R.q_domain('domain')} = 'restaurant')"


def shop(s: SparkSession, d: str) -> DataFrame:
    x = R.sample(s, d).where(X.known_domain(F.col("domain")) == "ecommerce")
    return x.select("row_ord", F.col("rating_original").alias("rating"), F.col("entity_name").alias("title"), F.col("review_text").alias("text"), F.col("entity_id").alias("asin"), F.when(F.col("row_ord") % 2 == 0, F.col("entity_id")).alias("parent_asin"), F.col("review_date").alias("timestamp"))


def meals(s: SparkSession, d: str) -> DataFrame:
    x = R.sample(s, d).where(X.known_domain(F.col("domain")) == "restaurant")
    return x.select("row_ord", F.col("entity_id").alias("Yelp URL"), F.col("rating_original").alias("Rating"), F.col("review_date").alias("Date"), F.col("review_text").alias("Review Text"))


def q_clip(x: str) -> str:
    return f"CASE WHEN {R.q_number(x)} IS NOT NULL THEN least(5.0, greatest(1.0, {R.q_number(x)})) END"


@query("std_ecommerce", f"""SELECT * FROM (SELECT 'ecommerce_' || row_ord AS review_id, 'ecommerce' AS domain, coalesce(parent_asin, asin, '') AS entity_id, coalesce(parent_asin, asin, '') AS entity_name, {R.q_squeeze('text')} AS review_text,
    {R.q_safe('rating')} AS rating, timestamp AS review_date FROM {_SHOP}) WHERE review_text <> ''""")
def _(s: SparkSession, d: str) -> DataFrame:
    return standardise.shop(shop(s, d))


@query("std_ecommerce_legacy", f"""SELECT *, md5(concat_ws('_', 'ecommerce', coalesce(entity_id, ''), review_text)) AS review_id FROM (SELECT 'ecommerce' AS domain, coalesce(parent_asin, asin) AS entity_id,
    trim({R.q_squeeze("coalesce(title, '') || '. ' || coalesce(text, '')")}, '. ') AS review_text, {q_clip('rating')} AS rating FROM {_SHOP}) WHERE review_text <> '' AND rating IS NOT NULL""")
def _(s: SparkSession, d: str) -> DataFrame:
    return standardise.shop_joined(shop(s, d))


@query("std_restaurant", f"""SELECT * FROM (SELECT 'restaurant_' || row_ord AS review_id, 'restaurant' AS domain, coalesce(url, '') AS entity_id, coalesce(url, '') AS entity_name, {R.q_squeeze('review_text')} AS review_text, {R.q_safe('rating')} AS rating, review_date FROM {_MEALS}) WHERE review_text <> ''""")
def _(s: SparkSession, d: str) -> DataFrame:
    return standardise.restaurant(meals(s, d))


@query("std_restaurant_legacy", f"""SELECT *, md5(concat_ws('_', 'restaurant', coalesce(entity_id, ''), review_text)) AS review_id FROM (SELECT 'restaurant' AS domain, url AS entity_id, {R.q_squeeze('review_text')} AS review_text, {q_clip('rating')} AS rating FROM {_MEALS})
    WHERE review_text <> '' AND rating IS NOT NULL""")
def _(s: SparkSession, d: str) -> DataFrame:
    return standardise.restaurant_joined(meals(s, d))


@query("std_mobile_legacy", f"""SELECT domain, entity_id, review_text, rating, CASE WHEN given <> '' THEN given ELSE md5(concat_ws('_', 'mobile_app', coalesce(entity_id, ''), review_text)) END AS review_id FROM (
    SELECT coalesce(review_id, '') AS given, 'mobile_app' AS domain, app_id AS entity_id, {R.q_squeeze('content')} AS review_text, {q_clip('CAST(score AS VARCHAR)')} AS rating FROM mobile_app_raw) WHERE review_text <> '' AND rating IS NOT NULL""")
def _(s: SparkSession, d: str) -> DataFrame:
    return standardise.mobile_app_joined(table(s, d, "mobile_app_raw"))


@query("std_dispatch", f"""SELECT domain, count(*) AS n, round(avg(rating), 4) AS avg_rating FROM (SELECT domain, rating FROM ({R.SQL['std_hotel']}) UNION ALL SELECT domain, rating FROM ({R.SQL['std_mobile']})
    UNION ALL SELECT domain, rating FROM ({SQL['std_ecommerce']}) UNION ALL SELECT domain, rating FROM ({SQL['std_restaurant']})) GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    """The four shapes, each by the standardiser of its domain, in one table of the common schema."""
    raw = {"hotel": table(s, d, "hotel_raw"), "mobile_app": table(s, d, "mobile_app_raw"), "ecommerce": shop(s, d), "restaurant": meals(s, d)}
    every = [standardise.standardise(df, domain) for domain, df in raw.items()]
    out = every[0]
    for df in every[1:]:
        out = out.unionByName(df)
    return out.groupBy("domain").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 4).alias("avg_rating"))


_TERM = lambda terms: " OR ".join(f"contains(x, '{t}')" for t in terms)


@query("std_maps_domain", f"""SELECT row_ord, CASE WHEN asked IN ('hotel', 'restaurant') THEN asked WHEN {_TERM(standardise.HOTEL_TERMS)} THEN 'hotel' ELSE 'restaurant' END AS value
    FROM (SELECT row_ord, lower(concat_ws(' ', coalesce(source, ''), coalesce(entity_name, ''))) AS x, lower(trim(coalesce(CASE WHEN row_ord % 5 = 0 THEN domain END, 'auto'))) AS asked FROM {R.SAMPLE})""")
def _(s: SparkSession, d: str) -> DataFrame:
    asked = F.when(F.col("row_ord") % 5 == 0, F.col("domain"))
    return R.sample(s, d).select("row_ord", standardise.maps_domain(F.col("source"), F.col("entity_name"), asked).alias("value"))


@query("std_play_common", f"""SELECT * FROM (SELECT coalesce(review_id, coalesce(app_id, 'app') || '_review_' || row_ord) AS review_id, 'mobile_app' AS domain, app_id AS entity_id, coalesce(app_title, app_id) AS entity_name, {R.q_squeeze('content')} AS review_text,
    {R.q_safe('CAST(score AS VARCHAR)')} AS rating, 'google_play' AS source FROM (SELECT *, coalesce(thumbs_up_count, 0) AS row_ord FROM mobile_app_raw)) WHERE review_text <> ''""")
def _(s: SparkSession, d: str) -> DataFrame:
    return standardise.play_store(table(s, d, "mobile_app_raw").withColumn("row_ord", F.coalesce("thumbs_up_count", F.lit(0))))


@query("std_aliases", f"SELECT row_ord, coalesce(review_text, '') AS content, coalesce({q_clip('CAST(rating AS VARCHAR)')}, 3.0) AS score, coalesce(entity_id, '') AS \"appId\", coalesce(review_id, '') AS \"reviewId\" FROM {R.SAMPLE}")
def _(s: SparkSession, d: str) -> DataFrame:
    return standardise.with_aliases(R.sample(s, d)).select("row_ord", "content", "score", "appId", "reviewId")


_GENERIC = f"""(SELECT row_ord, {R.q_domain('domain')} AS domain, {R.q_markup('review_text')} AS t, {R.q_key('review_text')} AS k, rating, {R.q_label('rating')} AS label FROM {R.CANON})"""


@query("build_rating_domain", f"""SELECT domain, k, label, row_ord FROM (SELECT *, row_number() OVER (PARTITION BY domain, k ORDER BY row_ord) AS rn, min(label) OVER (PARTITION BY domain, k) AS lo, max(label) OVER (PARTITION BY domain, k) AS hi
    FROM {_GENERIC} WHERE domain IN ('ecommerce', 'restaurant', 'mobile_app') AND rating BETWEEN 1 AND 5 AND t <> '' AND {R.q_words('t')} >= 4) WHERE rn = 1 AND lo = hi""")
def _(s: SparkSession, d: str) -> DataFrame:
    """One rule for the domains whose label comes from the rating: quality filter, conflicting texts out, the first of each text."""
    x = R.canon(s, d).select("row_ord", X.known_domain(F.col("domain")).alias("domain"), X.without_markup(R.T()).alias("t"), X.text_key(R.T()).alias("k"), "rating", X.rating_label(F.col("rating")).alias("label"))
    good = x.where(F.col("domain").isin("ecommerce", "restaurant", "mobile_app") & F.col("rating").between(1, 5) & (F.col("t") != "") & (X.word_count(F.col("t")) >= 4))
    keyed = good.select(F.struct("domain", "k").alias("key"), "label", "row_ord")
    return dedup.without_conflicts(keyed, "key", "label", "row_ord").select("key.domain", "key.k", "label", "row_ord")


@query("txt_placeholder", f"SELECT hotel_name, {R._HOTEL_SIDE('positive_review')} AS value, count(*) AS n FROM hotel_raw GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "hotel_raw").groupBy("hotel_name", X.placeholder_to_empty(F.col("positive_review")).alias("value")).agg(F.count("*").alias("n"))


# ---- fields of place pages, of addresses and labels made from the rows

_URL = "'https://www.google.com/maps/place/' || replace(coalesce(entity_name, 'x'), ' ', '+') || '/@' || (row_ord % 90) || '.25,-' || (row_ord % 180) || '.5,17z' || CASE row_ord % 4 WHEN 0 THEN '/data=!1s0x' || lower(to_hex(row_ord + 4096)) || ':0xab' WHEN 1 THEN '?cid=' || row_ord WHEN 2 THEN '?ftid=f' || row_ord ELSE '' END"
_LABEL = "CASE row_ord % 3 WHEN 0 THEN (row_ord % 5 + 1) || ' stars' WHEN 1 THEN (row_ord % 4 + 1) || ',5 star' ELSE 'no rating' END"
_COUNT = "CASE row_ord % 3 WHEN 0 THEN '1,' || (100 + row_ord % 900) || ' reviews' WHEN 1 THEN '1 review' ELSE '' END"


@query("src_maps_parse", f"""SELECT row_ord, CASE WHEN regexp_extract(u, '!1s(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)', 1) <> '' THEN regexp_extract(u, '!1s(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)', 1) WHEN regexp_extract(u, '[?&]cid=(\\d+)', 1) <> '' THEN regexp_extract(u, '[?&]cid=(\\d+)', 1)
        WHEN regexp_extract(u, '[?&]ftid=([^&]+)', 1) <> '' THEN regexp_extract(u, '[?&]ftid=([^&]+)', 1) WHEN regexp_extract(u, '/place/([^/]+)', 1) <> '' THEN substring(regexp_extract(u, '/place/([^/]+)', 1), 1, 160) ELSE 'place_' || substring(sha256(u), 1, 24) END AS entity_id,
    {R.q_squeeze("replace(regexp_extract(u, '/maps/place/([^/@?#]+)', 1), '+', ' ')")} AS name, regexp_extract(u, '@(-?\\d+(?:\\.\\d+)?),', 1) AS latitude, regexp_extract(u, '@-?\\d+(?:\\.\\d+)?,(-?\\d+(?:\\.\\d+)?)', 1) AS longitude,
    try_cast(replace(regexp_extract(l, '(?i)([1-5](?:[.,]\\d+)?)\\s*(?:stars?)?', 1), ',', '.') AS DOUBLE) AS rating, try_cast(regexp_replace(regexp_extract(n, '(?i)([\\d,.\\s]+)\\s+reviews?', 1), '\\D', '', 'g') AS BIGINT) AS reviews
    FROM (SELECT row_ord, {_URL} AS u, {_LABEL} AS l, {_COUNT} AS n FROM {R.SAMPLE})""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Identity, name and coordinates from a place's address, rating and number of reviews from its labels."""
    x = R.sample(s, d)
    string = lambda c: c.cast("string")
    r = F.col("row_ord")
    tail = F.when(r % 4 == 0, F.concat(F.lit("/data=!1s0x"), F.lower(F.hex(r + 4096)), F.lit(":0xab"))).when(r % 4 == 1, F.concat(F.lit("?cid="), string(r))).when(r % 4 == 2, F.concat(F.lit("?ftid=f"), string(r))).otherwise("")
    url = F.concat(F.lit("https://www.google.com/maps/place/"), F.replace(F.coalesce("entity_name", F.lit("x")), F.lit(" "), F.lit("+")), F.lit("/@"), string(r % 90), F.lit(".25,-"), string(r % 180), F.lit(".5,17z"), tail)
    label = F.when(r % 3 == 0, F.concat(string(r % 5 + 1), F.lit(" stars"))).when(r % 3 == 1, F.concat(string(r % 4 + 1), F.lit(",5 star"))).otherwise("no rating")
    count = F.when(r % 3 == 0, F.concat(F.lit("1,"), string(100 + r % 900), F.lit(" reviews"))).when(r % 3 == 1, "1 review").otherwise("")
    at = readers.place_coordinates(url)
    return x.select("row_ord", readers.place_id(url).alias("entity_id"), readers.place_name(url).alias("name"), at[0].alias("latitude"), at[1].alias("longitude"), readers.label_rating(label).alias("rating"), readers.label_count(count).alias("reviews"))


_LINKS = [
    ("https://www.google.com/maps/place/a", True), ("http://maps.google.co.uk/maps?q=1", True), ("https://google.de:443/maps", True), ("https://maps.app.goo.gl/abc", True), ("https://goo.gl/maps/abc", True),
    ("https://evilgoogle.com/maps", False), ("ftp://google.com/maps", False), ("https://user:word@google.com/maps", False), ("https://google.com:8080/maps", False), ("https://www.google.com/search", False), ("https://goo.gl/abc", False), ("", False),
]


@query("flt_url_allow", "SELECT * FROM (VALUES " + ", ".join(f"('{u}', {str(a).lower()})" for u, a in _LINKS) + ") v(url, allowed)")
def _(s: SparkSession, d: str) -> DataFrame:
    x = s.createDataFrame([(u,) for u, _ in _LINKS], "url string")
    return x.select("url", readers.maps_url_allowed(F.col("url")).alias("allowed"))


# ---- files: written into the checkpoint folder and read again


@query("src_csv_multi_encoding", f"SELECT row_ord, {R.q_squeeze('review_text')} AS review_text FROM {R.SAMPLE}")
def _(s: SparkSession, d: str) -> DataFrame:
    """A CSV in Latin-1 and one in UTF-8, told apart by their bytes."""
    x = R.sample(s, d).select("row_ord", X.squeeze(R.T()).alias("review_text"))
    folder = scratch(s)
    # what Latin-1 can hold, and the rest
    narrow = ~F.col("review_text").rlike(r"[^\x00-\x{FF}]")
    x.where(narrow).write.option("header", True).option("escape", '"').option("quoteAll", True).option("encoding", "ISO-8859-1").csv(f"{folder}/narrow")
    x.where(~narrow).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{folder}/wide")
    schema = "row_ord long, review_text string"
    parts = [readers.read_csv(s, f"{folder}/{p}", schema) for p in ("narrow", "wide")]
    return parts[0].unionByName(parts[1]).withColumn("review_text", F.coalesce("review_text", F.lit("")))


@query("src_csv_plain", f"SELECT row_ord, rating FROM {R.SAMPLE}")
def _(s: SparkSession, d: str) -> DataFrame:
    folder = scratch(s)
    writers.write_table(R.sample(s, d).select("row_ord", "rating"), folder, kind="csv")
    return readers.read_csv(s, folder, "row_ord long, rating double", multi_line=False)


@query("src_single_review", "SELECT 'single_1' AS review_id, 'hotel' AS domain, 'single_review' AS entity_id, 'single_review' AS entity_name, 'A quiet room' AS review_text, 4.0 AS rating, '4.0' AS rating_original, CAST(NULL AS VARCHAR) AS review_date, 'single_review' AS source, CAST(NULL AS VARCHAR) AS raw_source_path")
def _(s: SparkSession, d: str) -> DataFrame:
    return readers.single_review(s, " A quiet room ", 4.0, "hotel")


@query("snk_dataset", f"SELECT {R.q_domain('domain')} AS domain, count(*) AS n, sum(rating) AS ratings FROM {R.CANON} WHERE {R.q_domain('domain')} IS NOT NULL GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    """The dataset in a folder per domain, read again by domain."""
    folder = scratch(s)
    x = R.canon(s, d).withColumn("domain", X.known_domain(F.col("domain"))).where("domain IS NOT NULL")
    writers.write_table(x, folder, partition_by="domain")
    return s.read.parquet(folder).groupBy("domain").agg(F.count("*").alias("n"), F.sum("rating").alias("ratings"))


@query("snk_eval", f"SELECT label, support, f1 FROM ({R.SQL['evl_sentiment']})")
def _(s: SparkSession, d: str) -> DataFrame:
    """Evaluation tables of a run with their manifest, the newest run read again."""
    folder = scratch(s)
    judged = R.judged(s, d)
    tables = {"labels": summaries.precision_recall(judged, "actual", "predicted", list(X.LABELS)), "overall": summaries.overall(judged, "actual", "predicted", list(X.LABELS))}
    writers.write_run(tables, f"{folder}/run_1", {"kind": "evaluation"})
    return s.read.parquet(f"{writers.latest_run(s, folder)}/labels").select("label", "support", "f1")


@query("src_latest_run", "SELECT 'run_2' AS name, 'second' AS note")
def _(s: SparkSession, d: str) -> DataFrame:
    """The newest finished run below a folder."""
    folder = scratch(s)
    one = s.createDataFrame([(1,)], "n int")
    for name, note in (("run_1", "first"), ("run_2", "second")):
        writers.write_run({"t": one}, f"{folder}/{name}", {"note": note})
    writers.write_table(one, f"{folder}/unfinished/t")
    last = writers.latest_run(s, folder)
    return s.createDataFrame([(last.rsplit("/", 1)[1], writers.read_manifest(s, last)["note"])], "name string, note string")


# ---- streams


@query("str_label_counts", f"SELECT {R.q_label('score')} AS label, count(*) AS n FROM mobile_app_raw GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    """The row-wise operators on a stream of files, run until what is there has been read, written as a table."""
    folder = scratch(s)
    table(s, d, "mobile_app_raw").select("content", F.col("score").cast("string").alias("score"), "review_at").write.parquet(f"{folder}/in")
    stream = s.readStream.schema("content string, score string, review_at timestamp").parquet(f"{folder}/in")
    labelled = streaming.scored(stream).withColumn("label", X.rating_label(X.number(F.col("score")))).select("label")
    run = labelled.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    run.awaitTermination()
    return s.read.schema("label string").parquet(f"{folder}/out").groupBy("label").agg(F.count("*").alias("n"))


# ---- further order and summaries


@query("ord_entity_risk", f"SELECT domain, entity_id, row_number() OVER (ORDER BY avg_rating, negative_pct DESC, reviews DESC, domain NULLS LAST, entity_id NULLS LAST) AS place FROM ({R._ENTITY}) ORDER BY place LIMIT 50")
def _(s: SparkSession, d: str) -> DataFrame:
    """The first fifty entities: worst mean first, then the most bad reviews, then the most reviews."""
    order = [F.asc_nulls_last("avg_rating"), F.desc_nulls_last("negative_pct"), F.desc("reviews"), F.asc_nulls_last("domain"), F.asc_nulls_last("entity_id")]
    top = summaries.entity_summary(R.labelled(s, d)).orderBy(*order).limit(50)
    return top.select("domain", "entity_id", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("ord_custom_category", f"SELECT label, n, row_number() OVER (ORDER BY CASE label WHEN 'negative' THEN 1 WHEN 'neutral' THEN 2 WHEN 'positive' THEN 3 ELSE 4 END) AS place FROM (SELECT label, count(*) AS n FROM {R._LABELLED} GROUP BY 1)")
def _(s: SparkSession, d: str) -> DataFrame:
    """Counts in the order of a scale, other values last."""
    counts = R.labelled(s, d).groupBy("label").agg(F.count("*").alias("n"))
    return summaries.by_scale(counts, "label", ["negative", "neutral", "positive"])


@query("ord_top_items", f"SELECT source, n FROM (SELECT source, count(*) AS n FROM {R.SAMPLE} WHERE source IS NOT NULL AND lower(source) NOT IN ('guest_survey_form') GROUP BY 1) WHERE n > 0 ORDER BY n DESC, source LIMIT 5")
def _(s: SparkSession, d: str) -> DataFrame:
    counts = R.sample(s, d).where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n"))
    return summaries.top_items(counts, "source", "n", 5, exclude=("guest_survey_form",))


@query("agg_flag_dist", f"SELECT label_method AS value, count(*) AS n FROM {R.CANON} GROUP BY 1 ORDER BY n DESC, value NULLS LAST LIMIT 100")
def _(s: SparkSession, d: str) -> DataFrame:
    return R.canon(s, d).groupBy(F.col("label_method").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(100)


@query("agg_penalty_summary", f"SELECT {R.q_domain('domain')} AS domain, round(avg(rating), 2) AS rating, round(avg({R.q_words('review_text')}), 2) AS words, round(avg(length(coalesce(review_text, ''))), 2) AS characters FROM {R.SAMPLE} GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    """Means of several numbers by domain."""
    x = R.sample(s, d).select(X.known_domain(F.col("domain")).alias("domain"), "rating", X.word_count(R.T()).alias("words"), F.length(F.coalesce("review_text", F.lit(""))).alias("characters"))
    return summaries.means(x, "domain", ["rating", "words", "characters"])
