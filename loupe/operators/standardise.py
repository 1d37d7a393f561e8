"""Source shapes to the common schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loupe.functions.text import clipped_rating, known_domain, placeholder_to_empty, review_id, safe_rating, squeeze, trimmed, upload_domain
from loupe.operators.dedup import first_by

COMMON = T.StructType(
    [T.StructField(n, T.DoubleType() if n == "rating" else T.StringType()) for n in (
        "review_id", "domain", "entity_id", "entity_name", "review_text", "rating", "rating_original", "review_date", "source", "raw_source_path")]
)


def conform(df: DataFrame, schema: T.StructType = COMMON) -> DataFrame:
    """The columns of the schema in order; missing ones are typed nulls, others are left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def number_text(c: Column) -> Column:
    """A number as text without an idle fraction, so engines agree on it."""
    return F.regexp_replace(F.round(c, 2).cast("string"), r"\.0$", "")


def hotel(df: DataFrame) -> DataFrame:
    """Negative side before positive side, placeholders dropped; the score is out of ten, so it is always halved."""
    text = squeeze(F.concat_ws(" ", placeholder_to_empty(F.col("negative_review")), placeholder_to_empty(F.col("positive_review"))))
    score = F.coalesce("reviewer_score", "average_score")
    rating = F.when(score.isNull(), 3.0).otherwise(F.least(F.lit(5.0), F.greatest(F.lit(1.0), score / 2)))
    return df.select(
        review_id(F.lit("hotel"), F.coalesce("hotel_name", F.lit("")), text).alias("review_id"), F.lit("hotel").alias("domain"), F.col("hotel_name").alias("entity_id"),
        F.col("hotel_name").alias("entity_name"), text.alias("review_text"), rating.alias("rating"), number_text(score).alias("rating_original"), "review_date", F.lit("hotel_raw").alias("source"),
    ).where("review_text <> ''")


def hotel_joined(df: DataFrame) -> DataFrame:
    """The older form: sides joined by a full stop, rows without a score dropped."""
    side = F.concat_ws(". ", placeholder_to_empty(F.col("negative_review")), placeholder_to_empty(F.col("positive_review")))
    return df.where("reviewer_score IS NOT NULL").select("hotel_name", F.btrim(side, F.lit(". ")).alias("review_text"), (F.col("reviewer_score") / 2).alias("rating")).where("review_text <> ''")


def mobile_app(df: DataFrame) -> DataFrame:
    text = squeeze(F.col("content"))
    return df.select(
        F.coalesce("review_id", review_id(F.lit("mobile_app"), F.coalesce("app_id", F.lit("")), text)).alias("review_id"), F.lit("mobile_app").alias("domain"), F.col("app_id").alias("entity_id"),
        F.coalesce("app_title", "app_id").alias("entity_name"), text.alias("review_text"), safe_rating(F.col("score")).alias("rating"), F.col("score").cast("string").alias("rating_original"),
        F.lit("mobile_app_raw").alias("source"),
    ).where("review_text <> ''")


def mobile_app_joined(df: DataFrame) -> DataFrame:
    """The older form: title from the app, rating clipped, rows without one dropped."""
    x = df.select(F.coalesce("review_id", F.lit("")).alias("given"), F.lit("mobile_app").alias("domain"), F.col("app_id").alias("entity_id"), squeeze(F.col("content")).alias("review_text"), clipped_rating(F.col("score")).alias("rating"))
    key = F.when(F.col("given") != "", F.col("given")).otherwise(review_id(F.lit("mobile_app"), F.coalesce("entity_id", F.lit("")), F.col("review_text")))
    return x.where("review_text <> '' AND rating IS NOT NULL").withColumn("review_id", key).drop("given")


def shop(df: DataFrame) -> DataFrame:
    """Products: the body alone, as a title often names the rating. df: row_ord, rating, title, text, asin, parent_asin, timestamp."""
    return df.select(
        F.concat(F.lit("ecommerce_"), F.col("row_ord").cast("string")).alias("review_id"), F.lit("ecommerce").alias("domain"), F.coalesce("parent_asin", "asin", F.lit("")).alias("entity_id"),
        F.coalesce("parent_asin", "asin", F.lit("")).alias("entity_name"), squeeze(F.col("text")).alias("review_text"), safe_rating(F.col("rating")).alias("rating"), F.col("timestamp").alias("review_date"),
    ).where("review_text <> ''")


def shop_joined(df: DataFrame) -> DataFrame:
    """The older form: title and body joined by a full stop, rating clipped, rows without one dropped."""
    body = squeeze(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("text", F.lit(""))))
    x = df.select(F.lit("ecommerce").alias("domain"), F.coalesce("parent_asin", "asin").alias("entity_id"), F.btrim(body, F.lit(". ")).alias("review_text"), clipped_rating(F.col("rating")).alias("rating"))
    return x.where("review_text <> '' AND rating IS NOT NULL").withColumn("review_id", review_id(F.lit("ecommerce"), F.coalesce("entity_id", F.lit("")), F.col("review_text")))


def restaurant(df: DataFrame) -> DataFrame:
    """df: row_ord, `Yelp URL`, Rating, Date, `Review Text`."""
    link = F.coalesce("Yelp URL", F.lit(""))
    return df.select(
        F.concat(F.lit("restaurant_"), F.col("row_ord").cast("string")).alias("review_id"), F.lit("restaurant").alias("domain"), link.alias("entity_id"), link.alias("entity_name"),
        squeeze(F.col("Review Text")).alias("review_text"), safe_rating(F.col("Rating")).alias("rating"), F.col("Date").alias("review_date"),
    ).where("review_text <> ''")


def restaurant_joined(df: DataFrame) -> DataFrame:
    """The older form: rating clipped, rows without one dropped."""
    x = df.select(F.lit("restaurant").alias("domain"), F.col("Yelp URL").alias("entity_id"), squeeze(F.col("Review Text")).alias("review_text"), clipped_rating(F.col("Rating")).alias("rating"))
    return x.where("review_text <> '' AND rating IS NOT NULL").withColumn("review_id", review_id(F.lit("restaurant"), F.coalesce("entity_id", F.lit("")), F.col("review_text")))


def play_store(df: DataFrame) -> DataFrame:
    """Store reviews in the common schema; a row without an id is named by its app and place. df: row_ord and the store's columns."""
    named = F.concat(F.coalesce("app_id", F.lit("app")), F.lit("_review_"), F.col("row_ord").cast("string"))
    return df.select(
        F.coalesce("review_id", named).alias("review_id"), F.lit("mobile_app").alias("domain"), F.col("app_id").alias("entity_id"), F.coalesce("app_title", "app_id").alias("entity_name"),
        squeeze(F.col("content")).alias("review_text"), safe_rating(F.col("score")).alias("rating"), F.lit("google_play").alias("source"),
    ).where("review_text <> ''")


def with_aliases(df: DataFrame) -> DataFrame:
    """content, score, appId and reviewId beside the common columns; the score is the rating, clipped."""
    text = F.coalesce("review_text", F.lit(""))
    return df.withColumns(
        {"content": text, "score": F.coalesce(clipped_rating(F.col("rating")), F.lit(3.0)), "appId": F.coalesce(F.col("entity_id").cast("string"), F.lit("")), "reviewId": F.coalesce(F.col("review_id").cast("string"), F.lit(""))}
    )


SHAPES = {"mobile_app": mobile_app, "hotel": hotel, "ecommerce": shop, "restaurant": restaurant}


def standardise(df: DataFrame, domain: str) -> DataFrame:
    """The standardiser of a domain, with the common columns; ValueError for any other."""
    if domain not in SHAPES:
        raise ValueError(f"no shape is known for {domain!r}")
    return conform(SHAPES[domain](df))


def maps_domain(category: Column, name: Column, requested: Column | None = None) -> Column:
    """hotel or restaurant of a place, as requested or by the words of its category and name; restaurant if nothing tells."""
    text = F.lower(F.concat_ws(" ", F.coalesce(category, F.lit("")), F.coalesce(name, F.lit(""))))
    has = lambda terms: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))
    found = F.when(has(HOTEL_TERMS), "hotel").when(has(RESTAURANT_TERMS), "restaurant").otherwise("restaurant")
    asked = F.lower(F.btrim(F.coalesce(requested, F.lit("auto")))) if requested is not None else F.lit("auto")
    return F.when(asked.isin("hotel", "restaurant"), asked).otherwise(found)


#: Words that tell a place's domain.
HOTEL_TERMS = ("hotel", "resort", "motel", "hostel", "lodging", "guest house", "guesthouse", "inn", "bed and breakfast", "serviced apartment")
RESTAURANT_TERMS = (
    "restaurant", "cafe", "café", "food", "diner", "bistro", "bakery", "pizza", "barbecue", "bbq", "buffet", "steakhouse", "fast food", "coffee shop", "tea house", "dhaba",
)


def already_common(df: DataFrame) -> DataFrame:
    """Rows of the common schema with all its columns: domain by alias, safe rating, blank texts and unknown domains out, the first of equal domain, entity and text.

    df: row_ord and the common columns; missing ones are filled: rating_original with the rating, review_date and raw_source_path with nothing.
    """
    x = conform(df).withColumn("row_ord", F.lit(None).cast("long")) if "row_ord" not in df.columns else conform(df, T.StructType([T.StructField("row_ord", T.LongType()), *COMMON.fields]))
    x = x.withColumns(
        {
            "domain": upload_domain(F.col("domain")), "review_text": squeeze(F.col("review_text")), "rating": safe_rating(F.col("rating")),
            "rating_original": F.coalesce("rating_original", safe_rating(F.col("rating")).cast("string")), "review_date": F.coalesce("review_date", F.lit("")),
            "source": F.coalesce("source", F.lit("uploaded_standard_csv")), "raw_source_path": F.coalesce("raw_source_path", F.lit("")),
        }
    )
    return first_by(x.where("domain IS NOT NULL AND review_text <> ''"), ["domain", "entity_id", "review_text"], "row_ord")


def final_cleanup(df: DataFrame) -> DataFrame:
    """All common columns; trimmed text, clipped rating, rows without either dropped, the first of equal domain, entity and text. df: row_ord and the common columns."""
    x = conform(df, T.StructType([T.StructField("row_ord", T.LongType()), *COMMON.fields]))
    x = x.withColumns({"review_text": trimmed(F.col("review_text")), "rating": clipped_rating(F.col("rating"))}).where("review_text <> '' AND rating IS NOT NULL")
    return first_by(x, ["domain", "entity_id", "review_text"], "row_ord")


def select_entity(df: DataFrame, domain: str | None = None, entity_id: str | None = None, name: str | None = None) -> DataFrame:
    """The rows of a domain and an entity, by its id or by a part of its name in any case; all rows if none fits."""
    fits = F.lit(True)
    if domain:
        fits &= F.coalesce(known_domain(F.col("domain")) == domain, F.lit(False))
    if entity_id:
        fits &= F.coalesce(F.col("entity_id") == entity_id, F.lit(False))
    if name:
        fits &= F.coalesce(F.contains(F.lower("entity_name"), F.lit(name.lower())), F.lit(False))
    chosen = df.where(fits)
    return df if chosen.isEmpty() else chosen


def detect_domain(columns: list[str], domains: set[str] | None = None) -> str:
    """The domain of a table by its domain values (several make it multidomain), else by its columns; multidomain if these tell nothing."""
    known = {d for d in domains or () if d in SHAPES}
    if known:
        return next(iter(known)) if len(known) == 1 else "multidomain"
    names = {c.lower().replace(" ", "_") for c in columns}
    if {"content", "score"} <= names:
        return "mobile_app"
    if {"rating", "text"} <= names and names & {"asin", "parent_asin"}:
        return "ecommerce"
    if {"hotel_name", "average_score"} <= names:
        return "hotel"
    if {"review_text", "rating", "yelp_url"} <= names or ({"review_text", "rating"} <= names and "domain" not in names):
        return "restaurant"
    return "multidomain"
