"""Issues named in review text, by a taxonomy table: domain, issue, label, severity, ord, keywords, phrases (arrays).

Phrases are the keywords as cleaned text has them. Scores of issues come from outside (any model that gives similarities); the rules
that turn them into decisions are expressions, in the order in which they apply.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loupe.functions.text import clean_text, has_phrase
from loupe.operators.retrieval import dot
from loupe.operators.taxonomy import PROBLEM_CUES, ROWS

#: Least similarity of an issue by domain, and for other domains.
BASE = {"mobile_app": 0.30, "hotel": 0.31, "ecommerce": 0.32, "restaurant": 0.31}
OTHER = 0.31
#: How far a word of the taxonomy lowers the threshold, its lowest value, and the lead it needs over the second issue.
RESCUE_MARGIN, RESCUE_FLOOR, LEAD = 0.08, 0.18, 0.04
#: What stands before a word that is complained of, and before one that is said to be absent. Boundaries are those of Unicode words.
_W = r"[^\p{L}\p{N}_]"
COMPLAINT = (
    rf"(^|{_W})(do +not|don't|dont) +want{_W}.{{0,79}}",
    rf"(^|{_W})(want|prefer){_W}(.{{0,79}}{_W})?but +not{_W}.{{0,79}}",
    rf"(^|{_W})but +not{_W}.{{0,79}}",
    rf"(^|{_W})(avoid|stop|remove|block|hide){_W}.{{0,79}}",
    rf"(^|{_W})(unwanted|offensive|disturbing|shameful|shamefull){_W}.{{0,49}}",
    rf"(^|{_W})(problem|issue|complaint){_W}.{{0,59}}",
    rf"(^|{_W})(shows?|showing|displaying|exposes?|exposing){_W}.{{0,59}}",
)
ABSENCE = (
    rf"(^|{_W})(no|without){_W}.{{0,34}}",
    rf"(^|{_W})free +from{_W}.{{0,34}}",
    rf"(^|{_W})(does +not|doesn't|doesnt|never){_W}(.{{0,24}}{_W})?(show|contain|include|have|display|feature)[\p{{L}}\p{{N}}_]*{_W}.{{0,44}}",
    rf"(^|{_W})not( +[\p{{L}}\p{{N}}_]+){{0,2}} +",
)


def phrase(keyword: str) -> str:
    """A keyword as cleaned text has it."""
    return " ".join("".join(c if c.isalnum() else " " for c in keyword).split())


def default_taxonomy(spark: SparkSession) -> DataFrame:
    rows = [(d, i, label, s, n, k, [phrase(x) for x in k]) for d, i, label, s, n, k in ROWS]
    return spark.createDataFrame(rows, "domain string, issue string, label string, severity int, ord int, keywords array<string>, phrases array<string>")


def mining_domain(c: Column) -> Column:
    """Unknown domains use the issues of mobile apps."""
    return F.when(c.isin(*BASE), c).otherwise("mobile_app")


def mine(reviews: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(row_ord, issue, severity, issues, cues): the gravest issue whose phrases the text holds, all of them, and the first five keywords of the gravest; no_issue if there is none.

    A taxonomy is a lookup of a few rows for each domain. Ties go by the taxonomy's order.
    """
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    tax = taxonomy.withColumn("phrases", F.transform("phrases", padded))
    per_domain = tax.groupBy("domain").agg(F.collect_list(F.struct((-F.col("severity")).alias("neg"), "ord", "issue", "phrases", "keywords")).alias("tax"))
    # the text is cleaned and padded once, not for every phrase
    x = reviews.select("row_ord", mining_domain(F.col("domain")).alias("domain"), padded(clean_text(F.col("review_text"))).alias("t")).join(F.broadcast(per_domain), "domain", "left")
    hit = F.filter(F.coalesce("tax", F.array().cast(per_domain.schema["tax"].dataType)), lambda i: F.exists(i["phrases"], lambda k: F.contains(F.col("t"), k)))
    kept = F.transform(hit, lambda i: F.struct(i["neg"].alias("neg"), i["ord"].alias("ord"), i["issue"].alias("issue"), i["keywords"].alias("keywords")))
    x = x.select("row_ord", F.sort_array(kept).alias("hits"))
    first = F.try_element_at("hits", F.lit(1))
    cues = F.coalesce(F.array_join(F.slice(first["keywords"], 1, 5), ", "), F.lit(""))
    return x.select(
        "row_ord", F.coalesce(first["issue"], F.lit("no_issue")).alias("issue"), F.coalesce(-first["neg"], F.lit(0)).alias("severity"),
        F.array_join(F.transform("hits", lambda h: h["issue"]), ",").alias("issues"), cues.alias("cues"),
    )


def problem_cue(cleaned: Column, cues: Iterable[str] = PROBLEM_CUES) -> Column:
    """Whether the text names a problem of any kind."""
    return F.exists(F.array(*[F.lit(phrase(c)) for c in cues]), lambda c: has_phrase(cleaned, c))


def matched(cleaned: Column, keywords: Column) -> Column:
    """The keywords that a text holds, the longest first, then in their order of characters."""
    as_phrase = lambda k: F.btrim(F.regexp_replace(k, r"[^a-z0-9]+", " "))
    found = F.array_distinct(F.filter(keywords, lambda k: has_phrase(cleaned, as_phrase(k))))
    keyed = F.transform(found, lambda k: F.concat((F.lit(1000) - F.length(k)).cast("string"), F.lit("|"), k))
    return F.transform(F.sort_array(keyed), lambda k: F.substring_index(k, "|", -1))


def _context(lower: Column, cues: Column, before: tuple[str, ...]) -> Column:
    flexible = lambda c: F.replace(c, F.lit(" "), F.lit(" +"))
    # the patterns are tried only where there is a cue, a row in a hundred or so
    return (F.size(cues) > 0) & F.exists(cues, lambda c: F.rlike(lower, F.concat(F.lit("(" + "|".join(f"({p})" for p in before) + ")"), flexible(c))))


def complaint_context(lower: Column, cues: Column) -> Column:
    """Whether one of the cues is spoken of as something unwanted. lower: the text in lower case with single spaces."""
    return _context(lower, cues, COMPLAINT)


def protective_context(lower: Column, cues: Column) -> Column:
    """Whether one of the cues is said to be absent; a complaint comes first."""
    return ~complaint_context(lower, cues) & _context(lower, cues, ABSENCE)


def threshold(domain: Column, rating: Column, sentiment: Column, problem: Column) -> Column:
    """The similarity that an issue needs: less in a bad review, more in a good one."""
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in BASE.items() for x in pair]), domain), F.lit(OTHER))
    chosen = (
        F.when((sentiment == "negative") | (rating <= 2), F.greatest(F.lit(0.26), base - 0.03))
        .when((sentiment == "neutral") | (rating == 3), base)
        .when(problem, base + 0.03)
        .otherwise(base + 0.10)
    )
    return F.round(chosen, 4)


def decided(x: DataFrame) -> DataFrame:
    """accepted, decision_threshold and reason for rows with rating, sentiment, similarity, second, standard (threshold), problem, cues, complaint, protective.

    The gates apply in this order: good review without any cue, absence in a good review, similarity, similarity with the support of a cue.
    """
    good = (F.col("rating") >= 4) | (F.col("sentiment") == "positive")
    cued = F.size("cues") > 0
    rescue = F.round(F.greatest(F.lit(RESCUE_FLOOR), F.col("standard") - RESCUE_MARGIN), 4)
    supported = (F.col("rating") <= 2) | F.col("sentiment").isin("negative", "neutral") | F.col("complaint")
    lead = F.round(F.col("similarity") - F.col("second"), 4) >= LEAD
    reason = (
        F.when(good & ~F.col("problem") & ~cued, "positive_no_problem_block")
        .when(F.col("protective") & ~F.col("complaint") & good, "protective_absence_context")
        .when(F.col("similarity") >= F.col("standard"), "semantic_threshold")
        .when(cued & ~F.col("protective") & supported & (F.col("similarity") >= rescue) & lead, "semantic_plus_taxonomy_cue")
        .otherwise("below_threshold")
    )
    x = x.withColumn("reason", reason)
    return x.withColumns(
        {"accepted": F.col("reason").isin("semantic_threshold", "semantic_plus_taxonomy_cue"), "decision_threshold": F.when(F.col("reason") == "semantic_plus_taxonomy_cue", rescue).otherwise(F.col("standard"))}
    )


def marked_no_issue(rating: Column, sentiment: Column, problem: Column, similarity: Column, standard: Column) -> Column:
    """The simpler gate, which knows of one similarity only."""
    good = (rating >= 4) | (sentiment == "positive")
    rescue = F.round(F.greatest(F.lit(RESCUE_FLOOR), standard - RESCUE_MARGIN), 4)
    supported = problem & ((rating <= 2) | sentiment.isin("negative", "neutral")) & (similarity >= rescue)
    return F.when(good & ~problem, True).when(similarity >= standard, False).when(supported, False).otherwise(True)


def severity_level(severity: Column) -> Column:
    return F.when(severity >= 25, "high").when(severity >= 15, "medium").when(severity > 0, "low").otherwise("none")


def issue_scores(segments: DataFrame, issues: DataFrame) -> DataFrame:
    """(review, issue, similarity, whole, segment): the best similarity of each issue of a review's group over its segments, and that of the first segment.

    segments: review, grp, segment, vec. issues: grp, issue, issue_vec, a table of a few rows for each group. Of equal similarities the first segment's counts.
    """
    pairs = segments.join(F.broadcast(issues), "grp").select("review", "segment", "issue", dot(F.col("vec"), F.col("issue_vec")).alias("s"))
    best = F.max(F.struct(F.col("s"), -F.col("segment"))).alias("b")
    x = pairs.groupBy("review", "issue").agg(best, F.max(F.when(F.col("segment") == 0, F.col("s"))).alias("whole"))
    return x.select("review", "issue", F.col("b.s").alias("similarity"), "whole", (-F.col("b.col2")).alias("segment"))


def ranked_issues(scores: DataFrame) -> DataFrame:
    """The scores with their place in the review; ties by issue."""
    return scores.withColumn("place", F.row_number().over(Window.partitionBy("review").orderBy(F.desc("similarity"), "issue")))


def detected(ranked: DataFrame, standard: float, most: int = 3) -> DataFrame:
    """(review, detected): the best issue, and the following ones at or above the standard threshold, `most` in all, as `issue:0.000`."""
    kept = ranked.where((F.col("place") <= most) & ((F.col("place") == 1) | (F.col("similarity") >= standard)))
    text = F.concat(F.col("issue").cast("string"), F.lit(":"), F.format_string("%.3f", F.col("similarity")))
    items = F.sort_array(F.collect_list(F.struct("place", text.alias("t"))))
    return kept.groupBy("review").agg(F.array_join(F.transform(items, lambda i: i["t"]), "; ").alias("detected"))
