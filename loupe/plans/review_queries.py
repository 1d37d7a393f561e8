"""Queries on reviews, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.functions import text as X
from loupe.operators import dedup, issues, retrieval, sampling, standardise, summaries
from loupe.operators.taxonomy import ROWS as TAXONOMY
from loupe.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


# ---- SQL forms of the column functions


def q_squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[\\s\\x0B\\p{{Z}}]+', ' ', 'g'))"


_URL = "(https?://[^ \\t\\r\\n]+)|(www\\.[^ \\t\\r\\n]+)"


def q_urls(x: str) -> str:
    return q_squeeze(f"regexp_replace(coalesce({x}, ''), '{_URL}', ' ', 'g')")


def q_markup(x: str) -> str:
    return q_urls(f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')")


def q_clean(x: str) -> str:
    bare = f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '{_URL}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s\\x0B]', ' ', 'g')"
    return q_squeeze(f"regexp_replace({bare}, '[\\p{{Nd}}_]+', ' ', 'g')")


def q_normal(x: str) -> str:
    return q_squeeze(f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '{_URL}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s\\x0B]', ' ', 'g')")


def q_key(x: str) -> str:
    return f"md5({q_clean(q_markup(x))})"


def q_number(x: str) -> str:
    return f"try_cast(trim({x}) AS DOUBLE)"


def q_safe(x: str) -> str:
    n = f"coalesce({q_number(x)}, 3.0)"
    return f"least(5.0, greatest(1.0, CASE WHEN {n} > 5 THEN {n} / 2 ELSE {n} END))"


def q_label(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'neutral' WHEN {x} <= 2 THEN 'negative' WHEN {x} < 4 THEN 'neutral' ELSE 'positive' END"


def q_alias(x: str, aliases: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in aliases.items()) + " END"


def q_domain(x: str) -> str:
    d = f"replace(lower({q_squeeze(x)}), '-', '_')"
    named = f"coalesce({q_alias(d, X.DOMAIN_ALIASES)}, replace({d}, ' ', '_'))"
    return f"CASE WHEN {named} IN {X.DOMAINS} THEN {named} END"


def q_upload_domain(x: str) -> str:
    d = f"lower(trim(coalesce({x}, '')))"
    named = f"coalesce({q_alias(d, X.UPLOAD_ALIASES)}, {d})"
    return f"CASE WHEN {named} IN {X.DOMAINS} THEN {named} END"


def q_says(x: str, placeholders: tuple[str, ...]) -> str:
    """The placeholders stand here as the rule has them, and are cleaned as the text is."""
    t = q_clean(q_markup(x))
    return f"({t} <> '' AND {t} NOT IN {placeholders})"


def q_known_label(x: str) -> str:
    return f"CASE lower({q_squeeze(x)}) WHEN 'neg' THEN 'negative' WHEN 'negative' THEN 'negative' WHEN 'pos' THEN 'positive' WHEN 'positive' THEN 'positive' WHEN 'neu' THEN 'neutral' WHEN 'neutral' THEN 'neutral' END"


def q_words(x: str) -> str:
    return f"len(list_filter(string_split({q_squeeze(x)}, ' '), lambda w: w <> ''))"


SAMPLE, CANON = "orchestrator_hotel_sample", "build_multidomain_dataset"


def sample(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, SAMPLE)


def canon(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, CANON)


# ---- text functions, over whole tables


def text_query(name: str, column, sql: str) -> None:  # noqa: ANN001
    @query(name, f"SELECT row_ord, {sql} AS value FROM {SAMPLE}")
    def run(s: SparkSession, d: str) -> DataFrame:
        return sample(s, d).select("row_ord", column().alias("value"))


def T():  # noqa: N802
    return F.col("review_text")


text_query("txt_clean", lambda: X.clean_text(T()), q_clean("review_text"))
text_query("txt_clean_html", lambda: X.without_markup(T()), q_markup("review_text"))
text_query("txt_clean_ws", lambda: X.squeeze(T()), q_squeeze("review_text"))
text_query("txt_clean_url", lambda: X.without_urls(T()), q_urls("review_text"))
text_query("txt_norm_key", lambda: X.text_key(T()), q_key("review_text"))
text_query("txt_norm_hash", lambda: X.text_hash(T()), f"sha256({q_normal('review_text')})")
text_query("txt_word_count", lambda: X.word_count(T()), f"CAST({q_words('review_text')} AS INTEGER)")
text_query("txt_truncate", lambda: F.substring(X.squeeze(T()), 1, 180), f"substring({q_squeeze('review_text')}, 1, 180)")
text_query("txt_review_id_md5", lambda: X.review_id(*[F.coalesce(c, F.lit("")) for c in ("domain", "entity_id", "review_text")]), "md5(concat_ws('_', coalesce(domain, ''), coalesce(entity_id, ''), coalesce(review_text, '')))")
text_query("txt_norm_domain", lambda: X.known_domain(F.col("domain")), q_domain("domain"))
text_query("txt_phrase_present", lambda: X.has_phrase(X.clean_text(T()), F.lit("had to be sent back")), f"contains(' ' || {q_clean('review_text')} || ' ', ' had to be sent back ')")
text_query("num_safe_rating", lambda: X.safe_rating(F.col("rating_original")), q_safe("rating_original"))
text_query("num_clip", lambda: X.clipped_rating(F.col("rating_original")), f"CASE WHEN {q_number('rating_original')} IS NOT NULL THEN least(5.0, greatest(1.0, {q_number('rating_original')})) END")
text_query("num_round_half_up", lambda: X.half_up(X.safe_rating(F.col("rating_original"))), f"CAST(floor({q_safe('rating_original')} + 0.5) AS INTEGER)")
text_query("num_round_half_even", lambda: F.bround(X.safe_rating(F.col("rating_original"))).cast("int"), f"CAST(round_even({q_safe('rating_original')}, 0) AS INTEGER)")
text_query("lbl_rating", lambda: X.rating_label(X.number(F.col("rating_original"))), q_label(q_number("rating_original")))
text_query("lbl_rating_strict", lambda: X.strict_rating_label(F.col("rating")), "CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' WHEN rating >= 4 THEN 'positive' END")
_EDGE = "[^\\p{L}\\p{N}_]"


def q_sentences(x: str) -> str:
    lines = f"regexp_replace(regexp_replace(coalesce({x}, ''), '[\\n\\r]+', chr(10), 'g'), '([.!?])[\\s\\x0B\\p{{Z}}]+', '\\1' || chr(10), 'g')"
    return f"list_filter(list_transform(string_split({lines}, chr(10)), lambda x: {q_squeeze('x')}), lambda x: x <> '')"


def q_clauses(x: str) -> str:
    once = lambda t: f"regexp_replace({t}, '(?i)({_EDGE}|^)(?:{X.CONTRASTS})({_EDGE}|$)', '\\1' || chr(10) || '\\2', 'g')"
    marked = f"regexp_replace({x}, '[,;:]', chr(10), 'g')"
    return f"string_split({once(once(marked))}, chr(10))"


def q_segments(x: str) -> str:
    trim = lambda t: f"trim({q_squeeze(t)}, ' -–—,;:')"
    parts = f"flatten(list_transform({q_sentences(x)}, lambda s: list_concat([s], {q_clauses('s')})))"
    every = f"list_concat([{trim(x)}], list_filter(list_transform({parts}, lambda p: {trim('p')}), lambda p: contains(p, ' ')))"
    return f"list_filter({every}, lambda p, i: list_position(list_transform({every}, lambda q: lower(q)), lower(p)) = i)[1:8]"


text_query("txt_segments", lambda: F.array_join(X.segments(T()), " | "), f"array_to_string({q_segments('review_text')}, ' | ')")
text_query("txt_sentences", lambda: F.array_join(X.sentences(T()), " | "), f"array_to_string({q_sentences('review_text')}, ' | ')")
text_query("txt_contrast_split", lambda: F.array_join(F.filter(F.transform(X.clauses(X.squeeze(T())), X.squeeze), lambda x: x != ""), " | "),
           f"array_to_string(list_filter(list_transform({q_clauses(q_squeeze('review_text'))}, lambda x: {q_squeeze('x')}), lambda x: x <> ''), ' | ')")
text_query("txt_title_label", lambda: X.title_label(X.known_domain(F.col("domain"))), f"array_to_string(list_transform(string_split(replace(coalesce({q_domain('domain')}, ''), '_', ' '), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')")
text_query("txt_name_match", lambda: X.name_match(F.col("entity_name"), F.col("entity_id")), """round((SELECT CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN greatest(0.82, least(length(a), length(b)) / greatest(length(a), length(b)))
    ELSE 2.0 * len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / (len(list_distinct(string_split(a, ' '))) + len(list_distinct(string_split(b, ' ')))) END
    FROM (SELECT %s AS a, %s AS b)), 4)""" % tuple(q_squeeze(f"regexp_replace(lower({q_squeeze(c)}), '[^\\p{{L}}\\p{{N}}_\\s\\x0B]', ' ', 'g')") for c in ("entity_name", "entity_id")))  # fmt: skip


@query("txt_norm_sentiment", f"SELECT row_ord, {q_known_label('sentiment_label')} AS value FROM {CANON}")
def _(s: SparkSession, d: str) -> DataFrame:
    return canon(s, d).select("row_ord", X.known_label(F.col("sentiment_label")).alias("value"))


@query("lbl_keep_supplied", f"SELECT row_ord, coalesce({q_known_label('sentiment_label')}, {q_label('rating')}) AS value FROM {CANON}")
def _(s: SparkSession, d: str) -> DataFrame:
    return canon(s, d).select("row_ord", F.coalesce(X.known_label(F.col("sentiment_label")), X.rating_label(F.col("rating"))).alias("value"))


# ---- source shapes

_HOTEL_SIDE = lambda c: f"CASE WHEN {q_squeeze(c)} IN {X.PLACEHOLDERS} THEN '' ELSE {q_squeeze(c)} END"
_HOTEL_SQL = f"""
    SELECT md5(concat_ws('_', 'hotel', coalesce(hotel_name, ''), review_text)) AS review_id, 'hotel' AS domain, hotel_name AS entity_id, hotel_name AS entity_name, review_text,
           CASE WHEN sc IS NULL THEN 3.0 ELSE least(5.0, greatest(1.0, sc / 2)) END AS rating, regexp_replace(CAST(round(sc, 2) AS VARCHAR), '\\.0$', '') AS rating_original, review_date, 'hotel_raw' AS source
    FROM (SELECT *, coalesce(reviewer_score, average_score) AS sc, {q_squeeze(f"concat_ws(' ', {_HOTEL_SIDE('negative_review')}, {_HOTEL_SIDE('positive_review')})")} AS review_text FROM hotel_raw)
    WHERE review_text <> ''"""


@query("std_hotel", _HOTEL_SQL)
def _(s: SparkSession, d: str) -> DataFrame:
    return standardise.hotel(table(s, d, "hotel_raw"))


@query("std_hotel_legacy", f"""SELECT * FROM (SELECT hotel_name, trim(concat_ws('. ', {_HOTEL_SIDE('negative_review')}, {_HOTEL_SIDE('positive_review')}), '. ') AS review_text, reviewer_score / 2 AS rating
    FROM hotel_raw WHERE reviewer_score IS NOT NULL) WHERE review_text <> ''""")
def _(s: SparkSession, d: str) -> DataFrame:
    return standardise.hotel_joined(table(s, d, "hotel_raw"))


@query("std_mobile", f"""SELECT coalesce(review_id, md5(concat_ws('_', 'mobile_app', coalesce(app_id, ''), t))) AS review_id, 'mobile_app' AS domain, app_id AS entity_id, coalesce(app_title, app_id) AS entity_name,
    t AS review_text, {q_safe('CAST(score AS VARCHAR)')} AS rating, CAST(score AS VARCHAR) AS rating_original, 'mobile_app_raw' AS source FROM (SELECT *, {q_squeeze('content')} AS t FROM mobile_app_raw) WHERE t <> ''""")
def _(s: SparkSession, d: str) -> DataFrame:
    return standardise.mobile_app(table(s, d, "mobile_app_raw"))


_COMMON_COLUMNS = "row_ord, review_id, domain, entity_id, entity_name, review_text, rating, rating_original, review_date, source, raw_source_path"
_FIRST = f"SELECT {_COMMON_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY domain, entity_id, review_text ORDER BY row_ord) AS rn FROM (%s)) WHERE rn = 1"


@query("std_standard_passthrough", _FIRST % f"""SELECT * FROM (SELECT row_ord, review_id, {q_upload_domain('domain')} AS domain, entity_id, entity_name, {q_squeeze('review_text')} AS review_text, {q_safe('CAST(rating AS VARCHAR)')} AS rating,
    rating_original, coalesce(review_date, '') AS review_date, coalesce(source, 'uploaded_standard_csv') AS source, coalesce(raw_source_path, '') AS raw_source_path FROM {SAMPLE} WHERE rating_original IS NOT NULL) WHERE domain IS NOT NULL AND review_text <> ''""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Rows whose original rating is known, as a number is written differently as text by different engines."""
    return standardise.already_common(sample(s, d).where("rating_original IS NOT NULL"))


@query("std_final_cleanup", _FIRST % f"""SELECT * FROM (SELECT * REPLACE (regexp_replace(coalesce(review_text, ''), '^[\\s\\x0B\\p{{Z}}]+|[\\s\\x0B\\p{{Z}}]+$', '', 'g') AS review_text, CASE WHEN rating IS NOT NULL THEN least(5.0, greatest(1.0, rating)) END AS rating) FROM {SAMPLE})
    WHERE review_text <> '' AND rating IS NOT NULL""")
def _(s: SparkSession, d: str) -> DataFrame:
    return standardise.final_cleanup(sample(s, d))


_SHAPES = {
    "store": ("reviewId", "content", "score", "appId"), "products": ("rating", "title", "text", "asin", "parent_asin"), "stays": ("Hotel_Name", "Positive_Review", "Negative_Review", "Average_Score"),
    "meals": ("Yelp URL", "Rating", "Date", "Review Text"), "anything": ("a", "b"),
}


@query("std_schema_detect", f"""SELECT * FROM (VALUES ('anything', 'multidomain'), ('hotel_raw', 'hotel'), ('meals', 'restaurant'), ('mobile_app_raw', 'mobile_app'), ('products', 'ecommerce'), ('stays', 'hotel'), ('store', 'mobile_app')) v(name, domain)
    UNION ALL SELECT 'sample', CASE WHEN count(*) > 1 THEN 'multidomain' WHEN count(*) = 1 THEN min(domain) ELSE 'multidomain' END FROM (SELECT DISTINCT domain FROM {SAMPLE} WHERE domain IN {X.DOMAINS})""")
def _(s: SparkSession, d: str) -> DataFrame:
    """The domain of a table by its domain values, else by its columns."""
    tables = _SHAPES | {t: tuple(table(s, d, t).columns) for t in ("hotel_raw", "mobile_app_raw")}
    rows = [(t, standardise.detect_domain(list(c))) for t, c in tables.items()]
    # four values at most
    seen = {r[0] for r in sample(s, d).where(F.col("domain").isin(*X.DOMAINS)).select("domain").distinct().collect()}
    return s.createDataFrame([*rows, ("sample", standardise.detect_domain(sample(s, d).columns, seen))], "name string, domain string")


# ---- filters

_CLEANED = f"(SELECT row_ord, {q_domain('domain')} AS domain, coalesce({q_known_label('sentiment_label')}, '') AS label, rating, {q_markup('review_text')} AS t, {q_key('review_text')} AS k, {q_clean(q_markup('review_text'))} AS norm FROM {CANON})"


def cleaned(s: SparkSession, d: str) -> DataFrame:
    x = canon(s, d)
    return x.select("row_ord", X.known_domain(F.col("domain")).alias("domain"), F.coalesce(X.known_label(F.col("sentiment_label")), F.lit("")).alias("label"), "rating", X.without_markup(T()).alias("t"), X.text_key(T()).alias("k"), X.normal_text(T(), digits=False).alias("norm"))


@query("flt_quality", f"SELECT row_ord, domain, label, rating FROM {_CLEANED} WHERE rating BETWEEN 1 AND 5 AND label <> '' AND t <> '' AND {q_words('t')} >= 4")
def _(s: SparkSession, d: str) -> DataFrame:
    return cleaned(s, d).where(F.col("rating").between(1, 5) & (F.col("label") != "") & (F.col("t") != "") & (X.word_count(F.col("t")) >= 4)).select("row_ord", "domain", "label", "rating")


@query("flt_required_nonnull", f"SELECT row_ord, review_text, rating FROM {SAMPLE} WHERE review_text IS NOT NULL AND rating IS NOT NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    return sample(s, d).select("row_ord", "review_text", "rating").na.drop(subset=["review_text", "rating"])


@query("flt_nonblank_clean", f"SELECT row_ord FROM {SAMPLE} WHERE {q_clean('review_text')} <> ''")
def _(s: SparkSession, d: str) -> DataFrame:
    return sample(s, d).where(X.clean_text(T()) != "").select("row_ord")


@query("flt_text_key_nonempty", f"SELECT row_ord FROM {_CLEANED} WHERE norm <> ''")
def _(s: SparkSession, d: str) -> DataFrame:
    return cleaned(s, d).where("norm <> ''").select("row_ord")


@query("flt_domain_known", f"SELECT row_ord, {q_domain('domain')} AS domain FROM {SAMPLE} WHERE {q_domain('domain')} IS NOT NULL AND {q_squeeze('review_text')} <> ''")
def _(s: SparkSession, d: str) -> DataFrame:
    return sample(s, d).select("row_ord", X.known_domain(F.col("domain")).alias("domain"), X.squeeze(T()).alias("t")).where("domain IS NOT NULL AND t <> ''").select("row_ord", "domain")


@query("flt_hotel_placeholder", f"SELECT hotel_name, {q_squeeze('negative_review')} AS side FROM hotel_raw WHERE {q_says('negative_review', X.NEGATIVE_PLACEHOLDERS)} AND {q_words('negative_review')} >= 4")
def _(s: SparkSession, d: str) -> DataFrame:
    side = F.col("negative_review")
    return table(s, d, "hotel_raw").where(X.says_something(side, X.NEGATIVE_PLACEHOLDERS) & (X.word_count(side) >= 4)).select("hotel_name", X.squeeze(side).alias("side"))


@query("flt_entity_select", f"SELECT row_ord, entity_name FROM {SAMPLE} WHERE contains(lower(entity_name), 'café') AND {q_domain('domain')} = 'hotel'")
def _(s: SparkSession, d: str) -> DataFrame:
    """By domain and part of the name, whatever the case."""
    return standardise.select_entity(sample(s, d), domain="hotel", name="CAFÉ").select("row_ord", "entity_name")


@query("flt_entity_fallback", f"SELECT row_ord FROM {SAMPLE}")
def _(s: SparkSession, d: str) -> DataFrame:
    """No row fits: all are taken."""
    return standardise.select_entity(sample(s, d), entity_id="no such entity").select("row_ord")


# ---- duplicates, conflicts, sets


@query("dedup_first", f"SELECT t_entity, t_text, row_ord FROM (SELECT coalesce(entity_id, '') AS t_entity, {q_squeeze('review_text')} AS t_text, row_ord, row_number() OVER (PARTITION BY coalesce(entity_id, ''), {q_squeeze('review_text')} ORDER BY row_ord) AS rn FROM {SAMPLE}) WHERE rn = 1")
def _(s: SparkSession, d: str) -> DataFrame:
    x = sample(s, d).select(F.coalesce("entity_id", F.lit("")).alias("t_entity"), X.squeeze(T()).alias("t_text"), "row_ord")
    return dedup.first_by(x, ["t_entity", "t_text"], "row_ord")


@query("dedup_conflict", f"SELECT k, label, row_ord FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY row_ord) AS rn, min(label) OVER (PARTITION BY k) AS lo, max(label) OVER (PARTITION BY k) AS hi FROM {_CLEANED}) WHERE rn = 1 AND lo = hi")
def _(s: SparkSession, d: str) -> DataFrame:
    return dedup.without_conflicts(cleaned(s, d).select("k", "label", "row_ord"), "k", "label", "row_ord")


@query("agg_build_audit", f"""WITH g AS (SELECT k, count(*) AS n, min(label) <> max(label) AS bad FROM {_CLEANED} GROUP BY k)
    SELECT CAST(sum(n) AS BIGINT) AS input_rows, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS conflicting_keys, CAST(sum(CASE WHEN bad THEN n ELSE 0 END) AS BIGINT) AS conflicting_rows,
           CAST(sum(CASE WHEN bad THEN 0 ELSE n - 1 END) AS BIGINT) AS duplicate_rows, CAST(sum(CASE WHEN bad THEN 0 ELSE 1 END) AS BIGINT) AS output_rows FROM g""")
def _(s: SparkSession, d: str) -> DataFrame:
    return dedup.conflict_audit(cleaned(s, d), "k", "label")


@query("dedup_cross_domain", f"SELECT k, count(DISTINCT domain) AS groups FROM {_CLEANED} GROUP BY k HAVING count(DISTINCT domain) > 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return dedup.keys_across(cleaned(s, d), "k", "domain")


@query("agg_nunique_having", f"SELECT k, count(DISTINCT label) AS groups FROM {_CLEANED} GROUP BY k HAVING count(DISTINCT label) > 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return dedup.keys_across(cleaned(s, d), "k", "label")


@query("dedup_text_hash", f"SELECT sha256({q_normal('review_text')}) AS h, min(row_ord) AS row_ord, count(*) AS copies FROM {SAMPLE} GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return sample(s, d).groupBy(X.text_hash(T()).alias("h")).agg(F.min("row_ord").alias("row_ord"), F.count("*").alias("copies"))


_UNION = f"SELECT {q_key('review_text')} AS k FROM {SAMPLE} UNION ALL SELECT {q_key('review_text')} FROM {CANON}"


def both_keys(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return sample(s, d).select(X.text_key(T()).alias("k")), canon(s, d).select(X.text_key(T()).alias("k"))


@query("join_conflict_anti", f"SELECT row_ord FROM {_CLEANED} WHERE k NOT IN (SELECT k FROM {_CLEANED} GROUP BY k HAVING min(label) <> max(label))")
def _(s: SparkSession, d: str) -> DataFrame:
    """Rows whose text carries one label only; repeated texts stay."""
    x = cleaned(s, d).select("row_ord", "k", "label")
    blocked = x.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    return x.join(blocked.select("k"), "k", "left_anti").select("row_ord")


@query("win_first_per_key", f"SELECT k, min(row_ord) AS row_ord FROM {_CLEANED} GROUP BY k")
def _(s: SparkSession, d: str) -> DataFrame:
    return dedup.first_by(cleaned(s, d).select("k", "row_ord"), ["k"], "row_ord")


@query("set_union_all", f"SELECT k, count(*) AS n FROM ({_UNION}) GROUP BY k")
def _(s: SparkSession, d: str) -> DataFrame:
    a, b = both_keys(s, d)
    return a.unionByName(b).groupBy("k").agg(F.count("*").alias("n"))


@query("set_union_distinct", f"SELECT DISTINCT k FROM ({_UNION})")
def _(s: SparkSession, d: str) -> DataFrame:
    a, b = both_keys(s, d)
    return a.union(b).distinct()


@query("set_intersect", f"SELECT {q_key('review_text')} AS k FROM {SAMPLE} INTERSECT SELECT {q_key('review_text')} FROM {CANON}")
def _(s: SparkSession, d: str) -> DataFrame:
    a, b = both_keys(s, d)
    return a.intersect(b)


@query("set_except", f"SELECT {q_key('review_text')} AS k FROM {SAMPLE} EXCEPT SELECT {q_key('review_text')} FROM {CANON}")
def _(s: SparkSession, d: str) -> DataFrame:
    a, b = both_keys(s, d)
    return a.distinct().join(b, "k", "left_anti")


@query("join_split_leak", f"WITH k AS (SELECT DISTINCT {q_key('review_text')} AS k, split FROM {CANON} JOIN review_splits USING (row_ord)) SELECT DISTINCT a.k, b.split FROM k a JOIN k b USING (k) WHERE a.split = 'train' AND b.split <> 'train'")
def _(s: SparkSession, d: str) -> DataFrame:
    k = canon(s, d).join(table(s, d, "review_splits"), "row_ord").select(X.text_key(T()).alias("k"), "split").distinct()
    return k.where("split <> 'train'").join(k.where("split = 'train'").select("k"), "k", "left_semi").select("k", "split")


@query("join_entity_reviews", f"SELECT row_ord, entity_id FROM {SAMPLE} WHERE entity_id IN (SELECT entity_id FROM {CANON})")
def _(s: SparkSession, d: str) -> DataFrame:
    return sample(s, d).select("row_ord", "entity_id").join(canon(s, d).select("entity_id"), "entity_id", "left_semi").select("row_ord", "entity_id")


# ---- aggregations and windows

_LABELLED = f"(SELECT row_ord, {q_domain('domain')} AS domain, entity_id, entity_name, rating, coalesce({q_known_label('sentiment_label')}, {q_label('rating')}) AS label FROM {CANON})"


def labelled(s: SparkSession, d: str) -> DataFrame:
    label = F.coalesce(X.known_label(F.col("sentiment_label")), X.rating_label(F.col("rating")))
    return canon(s, d).select("row_ord", X.known_domain(F.col("domain")).alias("domain"), "entity_id", "entity_name", "rating", label.alias("label"))


@query("agg_count_table", f"SELECT coalesce(label, 'unknown') AS value, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM {CANON}), 2) AS percent FROM {_LABELLED} GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return summaries.value_counts(labelled(s, d), "label")


@query("agg_distributions", f"""SELECT entity_id, string_agg(label || ': ' || n, ', ' ORDER BY label) AS labels FROM (SELECT entity_id, coalesce(label, 'unknown') AS label, count(*) AS n FROM {_LABELLED} GROUP BY 1, 2) GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    """The counts of each entity's labels, as a map in the operator and as text in the query."""
    x = summaries.distribution(labelled(s, d), ["entity_id"], "label")
    pairs = F.array_sort(F.map_entries("distribution"))
    return x.select("entity_id", F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit(": "), p["value"].cast("string"))), ", ").alias("labels"))


@query("agg_crosstab", f"SELECT domain, count(*) FILTER (label = 'negative') AS negative, count(*) FILTER (label = 'neutral') AS neutral, count(*) FILTER (label = 'positive') AS positive FROM {_LABELLED} GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return summaries.crosstab(labelled(s, d), "domain", "label", list(X.LABELS))


@query("agg_dist_matrix", f"SELECT domain, label, count(*) AS n FROM {_LABELLED} GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    return labelled(s, d).groupBy("domain", "label").agg(F.count("*").alias("n"))


_ENTITY = f"""SELECT domain, entity_id, min(entity_name) AS entity_name, count(*) AS reviews, round(avg(rating), 2) AS avg_rating, min(rating) AS min_rating, max(rating) AS max_rating,
    round(avg(CASE WHEN label = 'negative' THEN 1.0 ELSE 0.0 END) * 100, 2) AS negative_pct, round(avg(CASE WHEN label = 'positive' THEN 1.0 ELSE 0.0 END) * 100, 2) AS positive_pct FROM {_LABELLED} GROUP BY 1, 2"""


@query("agg_entity_summary", _ENTITY)
def _(s: SparkSession, d: str) -> DataFrame:
    return summaries.entity_summary(labelled(s, d))


@query("ord_top_risky", f"SELECT * FROM ({_ENTITY}) ORDER BY avg_rating, negative_pct DESC, reviews DESC, domain, entity_id LIMIT 20")
def _(s: SparkSession, d: str) -> DataFrame:
    return summaries.entity_summary(labelled(s, d)).orderBy("avg_rating", F.desc("negative_pct"), F.desc("reviews"), F.asc_nulls_last("domain"), "entity_id").limit(20)


@query("ord_headline_entity", f"SELECT entity_id, count(*) AS n FROM {_LABELLED} GROUP BY 1 ORDER BY n DESC, entity_id LIMIT 6")
def _(s: SparkSession, d: str) -> DataFrame:
    return labelled(s, d).groupBy("entity_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_id").limit(6)


@query("agg_evidence_examples", f"""SELECT entity_id, string_agg(substring(t, 1, 220), ' || ' ORDER BY standing, row_ord) AS examples FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY standing, row_ord) AS rn FROM (SELECT row_ord, entity_id, {q_squeeze('review_text')} AS t, coalesce(rating, 100.0) AS standing FROM {SAMPLE}) WHERE t <> '') WHERE rn <= 3 GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    """The three worst reviews of each entity that say something, 220 characters of each; reviews without a rating come last."""
    x = sample(s, d).select("row_ord", "entity_id", X.squeeze(T()).alias("t"), F.coalesce("rating", F.lit(100.0)).alias("standing")).where("t <> ''")
    three = summaries.lowest_per_group(x, ["entity_id"], [F.col("standing"), F.col("row_ord")], 3)
    items = F.sort_array(F.collect_list(F.struct("rank", F.substring("t", 1, 220).alias("t"))))
    return three.groupBy("entity_id").agg(F.array_join(F.transform(items, lambda i: i["t"]), " || ").alias("examples"))


@query("agg_class_weights", f"SELECT label, count(*) AS n, round((SELECT count(*) FROM {CANON}) / ((SELECT count(DISTINCT label) FROM {_LABELLED}) * count(*)), 6) AS weight FROM {_LABELLED} GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return summaries.class_weights(labelled(s, d), "label")


@query("agg_domain_performance", f"""SELECT p.*, m.label AS modal_label FROM (SELECT coalesce(domain, 'unknown') AS domain, count(*) AS reviews, round(avg(rating), 2) AS avg_rating, min(rating) AS min_rating, max(rating) AS max_rating, count(DISTINCT entity_id) AS entities,
        round(avg(CASE WHEN label = 'negative' THEN 1.0 ELSE 0.0 END) * 100, 2) AS negative_pct, round(avg(CASE WHEN label = 'neutral' THEN 1.0 ELSE 0.0 END) * 100, 2) AS neutral_pct, round(avg(CASE WHEN label = 'positive' THEN 1.0 ELSE 0.0 END) * 100, 2) AS positive_pct FROM {_LABELLED} GROUP BY 1) p
    JOIN (SELECT coalesce(domain, 'unknown') AS domain, label, row_number() OVER (PARTITION BY coalesce(domain, 'unknown') ORDER BY count(*) DESC, label) AS rn FROM {_LABELLED} GROUP BY 1, 2) m ON p.domain = m.domain AND m.rn = 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    x = labelled(s, d).withColumn("domain", F.coalesce("domain", F.lit("unknown")))
    share = lambda v: F.round(F.avg((F.col("label") == v).cast("double")) * 100, 2).alias(f"{v}_pct")
    numbers = [F.count("*").alias("reviews"), F.round(F.avg("rating"), 2).alias("avg_rating"), F.min("rating").alias("min_rating"), F.max("rating").alias("max_rating"), F.count_distinct("entity_id").alias("entities")]
    modal = summaries.top_values(x, ["domain"], "label", 1).select("domain", F.col("label").alias("modal_label"))
    return x.groupBy("domain").agg(*numbers, *[share(v) for v in X.LABELS]).join(modal, "domain")


@query("agg_min_max_date", f"SELECT source, min(review_date) AS first, max(review_date) AS last FROM {SAMPLE} GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return sample(s, d).groupBy("source").agg(F.min("review_date").alias("first"), F.max("review_date").alias("last"))


@query("agg_dashboard_totals", f"SELECT count(*) AS reviews, count(DISTINCT entity_id) AS entities, round(avg(coalesce(rating, 0)), 4) AS avg_rating FROM {SAMPLE}")
def _(s: SparkSession, d: str) -> DataFrame:
    return sample(s, d).agg(F.count("*").alias("reviews"), F.count_distinct("entity_id").alias("entities"), F.round(F.avg(F.coalesce("rating", F.lit(0.0))), 4).alias("avg_rating"))


@query("win_row_index", f"SELECT row_ord, row_number() OVER (PARTITION BY source ORDER BY row_ord) AS i FROM {SAMPLE}")
def _(s: SparkSession, d: str) -> DataFrame:
    return sampling.ranked(sample(s, d).select("row_ord", "source"), ["source"], ["row_ord"], F.floor(F.col("row_ord") / 10_000), "i").select("row_ord", "i")


@query("smp_shuffle", f"SELECT row_ord, row_number() OVER (ORDER BY md5(CAST(row_ord AS VARCHAR) || '_42'), row_ord) AS place FROM {CANON}")
def _(s: SparkSession, d: str) -> DataFrame:
    return sampling.shuffled(canon(s, d).select("row_ord"), "row_ord")


@query("smp_domain_n", f"SELECT row_ord, domain FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5(CAST(row_ord AS VARCHAR) || '_42'), row_ord) AS turn FROM {_LABELLED} WHERE domain IS NOT NULL) WHERE turn <= 10")
def _(s: SparkSession, d: str) -> DataFrame:
    return sampling.exactly_per_group(labelled(s, d).where("domain IS NOT NULL").select("row_ord", "domain"), "domain", "row_ord", 10)


# ---- sampling

_DRAW = "md5(CAST(row_ord AS VARCHAR) || '_42')"


@query("smp_exact_stratified", f"SELECT row_ord, domain FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {_DRAW}, row_ord) AS turn FROM {_LABELLED} WHERE domain IS NOT NULL) ORDER BY turn, domain LIMIT 200")
def _(s: SparkSession, d: str) -> DataFrame:
    return sampling.round_robin(labelled(s, d).where("domain IS NOT NULL").select("row_ord", "domain"), "domain", "row_ord", 200)


@query("smp_balanced_floor", f"SELECT row_ord, domain FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {_DRAW}, row_ord) AS turn FROM {_LABELLED} WHERE domain IS NOT NULL) WHERE turn <= 25")
def _(s: SparkSession, d: str) -> DataFrame:
    return sampling.per_group(labelled(s, d).where("domain IS NOT NULL").select("row_ord", "domain"), "domain", "row_ord", 100 // 4)


@query("smp_per_class", f"SELECT row_ord, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_DRAW}, row_ord) AS turn FROM {_LABELLED}) WHERE turn <= 33")
def _(s: SparkSession, d: str) -> DataFrame:
    return sampling.per_group(labelled(s, d).select("row_ord", "label"), "label", "row_ord", 100 // 3)


@query("split_stratified", f"""SELECT row_ord, turn <= floor(n * 0.15 + 0.5) AS is_validation FROM (SELECT row_ord, row_number() OVER (PARTITION BY domain, label ORDER BY {_DRAW}, row_ord) AS turn, count(*) OVER (PARTITION BY domain, label) AS n FROM {_LABELLED})""")
def _(s: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_split(labelled(s, d), ["domain", "label"], "row_ord", 0.15).select("row_ord", "is_validation")


# ---- evaluation: the label that the rating gives against the supplied one


def judged(s: SparkSession, d: str) -> DataFrame:
    return canon(s, d).select(X.known_label(F.col("sentiment_label")).alias("actual"), X.rating_label(F.col("rating")).alias("predicted"))


_JUDGED = f"(SELECT {q_known_label('sentiment_label')} AS actual, {q_label('rating')} AS predicted FROM {CANON})"


_COUNTS = """(SELECT label, count(*) FILTER (actual = label AND predicted = label) AS tp, count(*) FILTER (actual = label) AS support, count(*) FILTER (predicted = label) AS called
    FROM (%s) j CROSS JOIN (SELECT unnest(%s) AS label) v GROUP BY 1)"""
_PRF = """(SELECT label, support, tp, CASE WHEN called = 0 THEN 0.0 ELSE tp / called END AS p, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS q,
    CASE WHEN called + support = 0 THEN 0.0 ELSE 2 * tp / (called + support) END AS f FROM """


@query("evl_sentiment", f"SELECT label, support, round(p, 4) AS precision, round(q, 4) AS recall, round(f, 4) AS f1 FROM {_PRF}{_COUNTS % (f'SELECT * FROM {_JUDGED}', str(list(X.LABELS)))})")
def _(s: SparkSession, d: str) -> DataFrame:
    return summaries.precision_recall(judged(s, d), "actual", "predicted", list(X.LABELS))


def q_overall(rows: str, labels: str) -> str:
    """Accuracy, macro and weighted means over the labels."""
    return f"""SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 4) AS accuracy, round(avg(p), 4) AS macro_precision, round(avg(q), 4) AS macro_recall, round(avg(f), 4) AS macro_f1,
        round(avg(round(f, 4)), 4) AS macro_rounded_f1, round(sum(p * support) / sum(support), 4) AS weighted_precision, round(sum(q * support) / sum(support), 4) AS weighted_recall, round(sum(f * support) / sum(support), 4) AS weighted_f1
        FROM {_PRF}{_COUNTS % (rows, labels)})"""


@query("evl_multiclass", q_overall(f"SELECT * FROM {_JUDGED} WHERE actual IS NOT NULL", str(list(X.LABELS))))
def _(s: SparkSession, d: str) -> DataFrame:
    return summaries.overall(judged(s, d).where("actual IS NOT NULL"), "actual", "predicted", list(X.LABELS))


@query("evl_confusion", f"SELECT actual, count(*) FILTER (predicted = 'negative') AS negative, count(*) FILTER (predicted = 'neutral') AS neutral, count(*) FILTER (predicted = 'positive') AS positive FROM {_JUDGED} GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return summaries.crosstab(judged(s, d), "actual", "predicted", list(X.LABELS))


def q_star(x: str) -> str:
    return f"CAST(round_even(least(5.0, greatest(1.0, {x})), 0) AS INTEGER)"


#: The star that a label stands for.
_LABEL_STAR = "CASE %s WHEN 'negative' THEN 1 WHEN 'neutral' THEN 3 ELSE 5 END"
_STARS = f"SELECT {q_star('rating')} AS actual, {_LABEL_STAR % q_known_label('sentiment_label')} AS predicted FROM {CANON} WHERE rating IS NOT NULL AND {q_known_label('sentiment_label')} IS NOT NULL"


def stars(s: SparkSession, d: str) -> DataFrame:
    """The rating as a whole star against the star that the supplied label stands for."""
    x = canon(s, d).select("rating", X.known_label(F.col("sentiment_label")).alias("label")).where("rating IS NOT NULL AND label IS NOT NULL")
    return x.select(summaries.whole_star(F.col("rating")).alias("actual"), X.label_star(F.col("label")).alias("predicted"))


@query("evl_rating", f"""SELECT count(*) AS n, round(avg(CASE WHEN g = 0 THEN 1.0 ELSE 0.0 END), 4) AS exact, round(avg(CASE WHEN g <= 1 THEN 1.0 ELSE 0.0 END), 4) AS within_one, round(avg(g), 4) AS mae, round(avg(CASE WHEN g >= 2 THEN 1.0 ELSE 0.0 END) * 100, 2) AS mismatch_pct
    FROM (SELECT abs(actual - predicted) AS g FROM ({_STARS}))""")
def _(s: SparkSession, d: str) -> DataFrame:
    gap = F.abs(F.col("actual") - F.col("predicted"))
    rate = lambda c: F.avg(c.cast("double"))
    return stars(s, d).agg(F.count("*").alias("n"), F.round(rate(gap == 0), 4).alias("exact"), F.round(rate(gap <= 1), 4).alias("within_one"), F.round(F.avg(gap), 4).alias("mae"), F.round(rate(gap >= 2) * 100, 2).alias("mismatch_pct"))


@query("evl_rating_confusion", "SELECT v.actual, " + ", ".join(f"count(*) FILTER (predicted = {i}) AS star_{i}" for i in range(1, 6)) + f" FROM (SELECT unnest([1, 2, 3, 4, 5]) AS actual) v LEFT JOIN ({_STARS}) s ON v.actual = s.actual GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    """Five rows and five columns, zero where nothing falls."""
    named = stars(s, d).withColumn("star", F.concat(F.lit("star_"), F.col("predicted").cast("string")))
    every = s.createDataFrame([(i,) for i in range(1, 6)], "actual int")
    table_ = summaries.crosstab(named, "actual", "star", [f"star_{i}" for i in range(1, 6)])
    return every.join(table_, "actual", "left").na.fill(0)


_HOTEL_STARS = f"SELECT {q_star('reviewer_score / 2')} AS actual, {q_star('average_score / 2')} AS predicted FROM hotel_raw WHERE reviewer_score IS NOT NULL AND average_score IS NOT NULL"


@query("evl_star", f"""SELECT * FROM (SELECT round(avg(CASE WHEN g <= 1 THEN 1.0 ELSE 0.0 END), 4) AS within_one, round(avg(g), 4) AS mae, round(avg(CASE WHEN g >= 3 THEN 1.0 ELSE 0.0 END), 4) AS severe, round(avg(CASE WHEN g = 4 THEN 1.0 ELSE 0.0 END), 4) AS four_stars
    FROM (SELECT abs(actual - predicted) AS g FROM ({_HOTEL_STARS}))) CROSS JOIN ({q_overall(f"SELECT * FROM ({_HOTEL_STARS})", '[1, 2, 3, 4, 5]')})""")
def _(s: SparkSession, d: str) -> DataFrame:
    """A hotel's own score against its average, as whole stars."""
    x = table(s, d, "hotel_raw").where("reviewer_score IS NOT NULL AND average_score IS NOT NULL")
    return summaries.star_agreement(x.select(summaries.whole_star(F.col("reviewer_score") / 2).alias("actual"), summaries.whole_star(F.col("average_score") / 2).alias("predicted")), "actual", "predicted")


@query("evl_model_summary", f"""WITH m AS ({q_overall(f"SELECT * FROM {_JUDGED} WHERE actual IS NOT NULL", str(list(X.LABELS)))}), t AS ({q_overall(_STARS, '[1, 2, 3, 4, 5]')})
    SELECT component, metric, value FROM (SELECT 'sentiment' AS component, accuracy, macro_f1, weighted_f1 FROM m UNION ALL SELECT 'star', accuracy, macro_f1, weighted_f1 FROM t) UNPIVOT (value FOR metric IN (accuracy, macro_f1, weighted_f1))""")
def _(s: SparkSession, d: str) -> DataFrame:
    """A row per component and metric."""
    names = ["accuracy", "macro_f1", "weighted_f1"]
    parts = [("sentiment", summaries.overall(judged(s, d).where("actual IS NOT NULL"), "actual", "predicted", list(X.LABELS))), ("star", summaries.overall(stars(s, d), "actual", "predicted", [1, 2, 3, 4, 5]))]
    wide = [df.select(F.lit(c).alias("component"), *names) for c, df in parts]
    return wide[0].unionByName(wide[1]).unpivot("component", names, "metric", "value")


@query("evl_percent_scale", f"SELECT row_ord, CASE WHEN abs(v) <= 1.5 THEN v * 100 ELSE v END AS percent FROM (SELECT row_ord, {q_number('rating_original')} AS v FROM {SAMPLE})")
def _(s: SparkSession, d: str) -> DataFrame:
    return sample(s, d).select("row_ord", X.as_percent(X.number(F.col("rating_original"))).alias("percent"))


@query("lbl_star_sentiment", "SELECT row_ord, CASE WHEN star <= 2 THEN 'negative' WHEN star = 3 THEN 'neutral' ELSE 'positive' END AS value FROM (SELECT row_ord, " + q_star(q_safe("rating_original")) + f" AS star FROM {SAMPLE})")
def _(s: SparkSession, d: str) -> DataFrame:
    return sample(s, d).select("row_ord", X.star_label(summaries.whole_star(X.safe_rating(F.col("rating_original")))).alias("value"))


_WEIGHTS = "[1 + (row_ord * 10) % 11, 1 + (row_ord * 17) % 11, 1 + (row_ord * 24) % 11, 1 + (row_ord * 31) % 11, 1 + (row_ord * 38) % 11]"


def star_weights() -> Column:
    return F.array(*[1 + (F.col("row_ord") * (7 * i + 3)) % 11 for i in range(1, 6)])


@query("num_expected_star", f"SELECT row_ord, round(list_sum(list_transform(w, lambda x, i: x * i)) / list_sum(w), 4) AS value FROM (SELECT row_ord, {_WEIGHTS} AS w FROM {SAMPLE})")
def _(s: SparkSession, d: str) -> DataFrame:
    """The mean star of a distribution."""
    return sample(s, d).select("row_ord", F.round(X.expected_star(star_weights()), 4).alias("value"))


@query("num_argmax", f"SELECT row_ord, CAST(list_position(w, list_max(w)) AS BIGINT) AS star, round(list_max(w) / list_sum(w), 4) AS confidence FROM (SELECT row_ord, {_WEIGHTS} AS w FROM {SAMPLE})")
def _(s: SparkSession, d: str) -> DataFrame:
    """The first star of the greatest weight, and its share."""
    w = star_weights()
    return sample(s, d).select("row_ord", F.array_position(w, F.array_max(w)).alias("star"), F.round(F.array_max(w) / X.total(w), 4).alias("confidence"))


@query("mdl_sentiment_fallback", f"SELECT row_ord, {q_label('rating')} AS predicted_sentiment, 0.60 AS sentiment_confidence, 'rating' AS sentiment_source FROM {SAMPLE}")
def _(s: SparkSession, d: str) -> DataFrame:
    """Where no model is at hand the rating's label stands in, with a fixed confidence."""
    return sample(s, d).select("row_ord", X.rating_label(F.col("rating")).alias("predicted_sentiment"), F.lit(0.60).alias("sentiment_confidence"), F.lit("rating").alias("sentiment_source"))


@query("json_parse_safe", f"SELECT row_ord, coalesce(json_extract_string(j, '$.score'), '') AS score, coalesce(json_extract_string(j, '$.label'), '') AS label FROM (SELECT row_ord, CASE WHEN json_valid(b) THEN b END AS j FROM (SELECT row_ord, CASE row_ord % 3 WHEN 0 THEN '{{\"score\": ' || row_ord || ', \"label\": \"a\"}}' WHEN 1 THEN '{{\"score\": ' ELSE '{{\"label\": \"b\"}}' END AS b FROM {SAMPLE}))")
def _(s: SparkSession, d: str) -> DataFrame:
    """JSON as a model returns it: in a code fence with words round it, whole, or broken; what cannot be read is empty."""
    fence = F.lit("```")
    told = F.when(F.col("row_ord") % 3 == 0, F.concat(F.lit("Here: "), fence, F.lit('json {"score": '), F.col("row_ord").cast("string"), F.lit(', "label": "a"} '), fence)).when(F.col("row_ord") % 3 == 1, '{"score": ').otherwise('{"label": "b"}')
    read = X.parsed_json(told, "score string, label string")
    return sample(s, d).select("row_ord", read.alias("j")).select("row_ord", F.coalesce("j.score", F.lit("")).alias("score"), F.coalesce("j.label", F.lit("")).alias("label"))


# ---- issues, retrieval, latest records

_TAX = ", ".join(f"('{d}', '{i}', '{label}', {v}, {n}, [{', '.join(chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in k)}])" for d, i, label, v, n, k in TAXONOMY)
_TAX_ROWS = f"""SELECT *, list_transform(keywords, lambda k: trim(regexp_replace(k, '[^a-z0-9]+', ' ', 'g'))) AS phrases FROM (VALUES {_TAX}) t(domain, issue, label, severity, ord, keywords)"""


@query("iss_fallback", f"""WITH tax AS ({_TAX_ROWS}),
    r AS (SELECT row_ord, CASE WHEN domain IN ('mobile_app','hotel','ecommerce','restaurant') THEN domain ELSE 'mobile_app' END AS domain, {q_clean('review_text')} AS t FROM {SAMPLE}),
    h AS (SELECT row_ord, issue, severity, ord, keywords FROM r JOIN tax USING (domain) WHERE len(list_filter(phrases, lambda k: contains(' ' || t || ' ', ' ' || k || ' '))) > 0),
    g AS (SELECT row_ord, first(issue ORDER BY severity DESC, ord) AS issue, max(severity) AS severity, string_agg(issue, ',' ORDER BY severity DESC, ord) AS issues, first(array_to_string(keywords[1:5], ', ') ORDER BY severity DESC, ord) AS cues FROM h GROUP BY 1)
    SELECT row_ord, coalesce(issue, 'no_issue') AS issue, CAST(coalesce(severity, 0) AS INTEGER) AS severity, coalesce(issues, '') AS issues, coalesce(cues, '') AS cues FROM r LEFT JOIN g USING (row_ord)""")
def _(s: SparkSession, d: str) -> DataFrame:
    return issues.mine(sample(s, d), issues.default_taxonomy(s))


_VEC = "(SELECT vec_id, label % 4 AS g, md5(CAST(vec_id // 2 AS VARCHAR)) AS hash, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"


@query("win_topk_per_query", f"""WITH q AS (SELECT vec_id AS q_id, g, hash, vec FROM {_VEC} WHERE vec_id % 50 = 0), c AS (SELECT vec_id AS c_id, g, hash AS c_hash, vec AS c_vec FROM {_VEC}),
    s AS (SELECT q_id, c_id, hash, c_hash, round(list_dot_product(vec, c_vec), 4) AS score FROM q JOIN c USING (g)),
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, c_id) AS place FROM s) WHERE place <= 80 AND c_id <> q_id AND hash <> c_hash AND score >= 0.30),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id, c_hash ORDER BY score DESC, c_id) AS again FROM p) WHERE again = 1)
    SELECT q_id, c_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, c_id) AS rank FROM o) WHERE rank <= 3""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Queries: every row whose id is divisible by 50, against all rows."""
    v = table(s, d, "embeddings").select("vec_id", (F.col("label") % 4).alias("g"), F.md5(F.floor(F.col("vec_id") / 2).cast("string")).alias("hash"), F.col("embedding").alias("vec"))
    return retrieval.top_evidence(v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "q_id"), v.withColumnRenamed("vec_id", "c_id"), "g", least=0.30)


_TWICE = "list_transform(CAST(embedding AS DOUBLE[]), lambda e: e * (1 + vec_id % 5))"


@query("num_l2_normalise", f"SELECT vec_id, array_to_string(list_transform(list_transform(x, lambda e: e / sqrt(list_dot_product(x, x)))[1:4], lambda e: CAST(CAST(round(e * 10000) AS BIGINT) AS VARCHAR)), ' ') AS first_four FROM (SELECT vec_id, {_TWICE} AS x FROM embeddings)")
def _(s: SparkSession, d: str) -> DataFrame:
    """Vectors of any length made unit vectors: the first four numbers in ten thousandths."""
    long = F.transform("embedding", lambda e: e.cast("double") * (1 + F.col("vec_id") % 5))
    u = table(s, d, "embeddings").select("vec_id", retrieval.unit(long).alias("v"))
    return u.select("vec_id", F.array_join(F.transform(F.slice("v", 1, 4), lambda e: F.round(e * 10000).cast("long").cast("string")), " ").alias("first_four"))


@query("src_maps", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def _(s: SparkSession, d: str) -> DataFrame:
    """Last write wins."""
    latest = table(s, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("r"))
    return latest.select("user_id", "r.event_id", "r.event_type", "r.value")


@query("src_play_store", "SELECT app_id, content, score, count(*) AS copies, min(review_at) AS first_at, max(review_at) AS last_at FROM mobile_app_raw WHERE content IS NOT NULL AND score IS NOT NULL GROUP BY app_id, content, score")
def _(s: SparkSession, d: str) -> DataFrame:
    """A row for each different text, score and app, with the number of copies and the first and last date."""
    x = table(s, d, "mobile_app_raw").na.drop(subset=["content", "score"])
    return x.groupBy("app_id", "content", "score").agg(F.count("*").alias("copies"), F.min("review_at").alias("first_at"), F.max("review_at").alias("last_at"))
