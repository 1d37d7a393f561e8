"""Queries on issues and evidence, each with the SQL that gives the same rows.

Similarities that a model would give come from numbers of the row, or from the table of vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loupe.functions import text as X
from loupe.operators import issues, retrieval
from loupe.operators.taxonomy import PROBLEM_CUES
from loupe.plans import review_queries as R
from loupe.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# ---- one issue of its domain for each review, with similarities

_CUES = "[" + ", ".join(quoted(c) for c in PROBLEM_CUES) + "]"
_AS_PHRASE = "trim(regexp_replace(k, '[^a-z0-9]+', ' ', 'g'))"


def q_matched(cleaned: str, keywords: str) -> str:
    found = f"list_distinct(list_filter({keywords}, lambda k: contains(' ' || {cleaned} || ' ', ' ' || {_AS_PHRASE} || ' ')))"
    return f"list_transform(list_sort(list_transform({found}, lambda k: CAST(1000 - length(k) AS VARCHAR) || '|' || k)), lambda k: string_split(k, '|')[2])"


def q_context(lowered: str, cues: str, before: tuple[str, ...]) -> str:
    pattern = quoted("(" + "|".join(f"({p})" for p in before) + ")")
    return f"(len(list_filter({cues}, lambda c: regexp_matches({lowered}, {pattern} || replace(c, ' ', ' +')))) > 0)"


_BASE = f"CASE domain {' '.join(f'WHEN {quoted(d)} THEN {v}' for d, v in issues.BASE.items())} ELSE {issues.OTHER} END"
_RESCUE = f"round(greatest({issues.RESCUE_FLOOR}, standard - {issues.RESCUE_MARGIN}), 4)"
_ROWS = f"""(SELECT *, {q_matched('cleaned', 'keywords')} AS cues, {q_matched('cleaned', _CUES)} AS problem_cues FROM (
    SELECT r.*, t.issue, t.label, t.severity, t.keywords FROM (
        SELECT row_ord, CASE WHEN domain IN ('mobile_app', 'hotel', 'ecommerce', 'restaurant') THEN domain ELSE 'mobile_app' END AS domain, review_text, {R.q_clean('review_text')} AS cleaned, lower({R.q_squeeze('review_text')}) AS lowered,
            coalesce(rating, 3.0) AS rating, {R.q_label('rating')} AS sentiment, (row_ord % 71) / 100 AS similarity, least((row_ord % 71) / 100, (row_ord % 37) / 100) AS second FROM orchestrator_hotel_sample) r
    JOIN (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ord) - 1 AS k, count(*) OVER (PARTITION BY domain) AS m FROM ({R._TAX_ROWS})) t ON r.domain = t.domain AND r.row_ord % t.m = t.k))"""
_JUDGED = f"""(SELECT *, round(CASE WHEN sentiment = 'negative' OR rating <= 2 THEN greatest(0.26, base - 0.03) WHEN sentiment = 'neutral' OR rating = 3 THEN base WHEN problem THEN base + 0.03 ELSE base + 0.10 END, 4) AS standard,
    complaint_raw AS complaint, absence_raw AND NOT complaint_raw AS protective FROM (
    SELECT *, len(problem_cues) > 0 AS problem, {_BASE} AS base, {q_context('lowered', 'cues', issues.COMPLAINT)} AS complaint_raw, {q_context('lowered', 'cues', issues.ABSENCE)} AS absence_raw FROM {_ROWS}))"""


def scored(s: SparkSession, d: str) -> DataFrame:
    """Each review with an issue of its domain, similarities, and the cues that the text holds."""
    tax = issues.default_taxonomy(s)
    w = Window.partitionBy("domain")
    # a row per issue
    tax = tax.withColumns({"k": F.row_number().over(w.orderBy("ord")) - 1, "m": F.count("*").over(w)}).select(F.col("domain").alias("tax_domain"), "issue", "label", "severity", "keywords", "k", "m")
    hundredth = lambda m: (F.col("row_ord") % m) / 100
    x = R.sample(s, d).select(
        "row_ord", issues.mining_domain(F.col("domain")).alias("domain"), "review_text", X.clean_text(R.T()).alias("cleaned"), F.lower(X.squeeze(R.T())).alias("lowered"), F.coalesce("rating", F.lit(3.0)).alias("rating"),
        X.rating_label(F.col("rating")).alias("sentiment"), hundredth(71).alias("similarity"), F.least(hundredth(71), hundredth(37)).alias("second"),
    )
    x = x.join(F.broadcast(tax), (x["domain"] == tax["tax_domain"]) & (x["row_ord"] % tax["m"] == tax["k"])).drop("tax_domain", "k", "m")
    return x.withColumns({"cues": issues.matched(F.col("cleaned"), F.col("keywords")), "problem_cues": issues.matched(F.col("cleaned"), F.array(*[F.lit(c) for c in PROBLEM_CUES]))})


def judged(s: SparkSession, d: str) -> DataFrame:
    x = scored(s, d).withColumn("problem", F.size("problem_cues") > 0)
    x = x.withColumns({"complaint": issues.complaint_context(F.col("lowered"), F.col("cues")), "protective": issues.protective_context(F.col("lowered"), F.col("cues"))})
    return x.withColumn("standard", issues.threshold(F.col("domain"), F.col("rating"), F.col("sentiment"), F.col("problem")))


@query("ord_keywords_longest", f"SELECT row_ord, array_to_string(problem_cues, ', ') AS cues FROM {_ROWS}")
def _(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d).select("row_ord", F.array_join("problem_cues", ", ").alias("cues"))


@query("iss_problem_cue", f"SELECT row_ord, len(problem_cues) > 0 AS value FROM {_ROWS}")
def _(s: SparkSession, d: str) -> DataFrame:
    return R.sample(s, d).select("row_ord", issues.problem_cue(X.clean_text(R.T())).alias("value"))


@query("iss_complaint_ctx", f"SELECT row_ord, {q_context('lowered', 'problem_cues', issues.COMPLAINT)} AS value FROM {_ROWS}")
def _(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d).select("row_ord", issues.complaint_context(F.col("lowered"), F.col("problem_cues")).alias("value"))


@query("iss_protective_ctx", f"SELECT row_ord, NOT {q_context('lowered', 'problem_cues', issues.COMPLAINT)} AND {q_context('lowered', 'problem_cues', issues.ABSENCE)} AS value FROM {_ROWS}")
def _(s: SparkSession, d: str) -> DataFrame:
    return scored(s, d).select("row_ord", issues.protective_context(F.col("lowered"), F.col("problem_cues")).alias("value"))


@query("iss_dyn_threshold", f"SELECT row_ord, standard FROM {_JUDGED}")
def _(s: SparkSession, d: str) -> DataFrame:
    return judged(s, d).select("row_ord", "standard")


_DECIDED = f"""(SELECT *, CASE WHEN (rating >= 4 OR sentiment = 'positive') AND NOT problem AND len(cues) = 0 THEN 'positive_no_problem_block'
        WHEN protective AND NOT complaint AND (rating >= 4 OR sentiment = 'positive') THEN 'protective_absence_context' WHEN similarity >= standard THEN 'semantic_threshold'
        WHEN len(cues) > 0 AND NOT protective AND (rating <= 2 OR sentiment IN ('negative', 'neutral') OR complaint) AND similarity >= {_RESCUE} AND round(similarity - second, 4) >= {issues.LEAD} THEN 'semantic_plus_taxonomy_cue'
        ELSE 'below_threshold' END AS reason FROM {_JUDGED})"""


@query("iss_decide", f"""SELECT row_ord, CASE WHEN reason IN ('semantic_threshold', 'semantic_plus_taxonomy_cue') THEN issue ELSE 'no_issue' END AS issue, reason,
    CASE WHEN reason = 'semantic_plus_taxonomy_cue' THEN {_RESCUE} ELSE standard END AS decision_threshold FROM {_DECIDED}""")
def _(s: SparkSession, d: str) -> DataFrame:
    x = issues.decided(judged(s, d))
    return x.select("row_ord", F.when(F.col("accepted"), F.col("issue")).otherwise("no_issue").alias("issue"), "reason", "decision_threshold")


@query("iss_mark_no_issue", f"""SELECT row_ord, CASE WHEN (rating >= 4 OR sentiment = 'positive') AND NOT problem THEN true WHEN similarity >= standard THEN false
    WHEN problem AND (rating <= 2 OR sentiment IN ('negative', 'neutral')) AND similarity >= {_RESCUE} THEN false ELSE true END AS value FROM {_JUDGED}""")
def _(s: SparkSession, d: str) -> DataFrame:
    return judged(s, d).select("row_ord", issues.marked_no_issue(F.col("rating"), F.col("sentiment"), F.col("problem"), F.col("similarity"), F.col("standard")).alias("value"))


@query("iss_benchmark_rule", f"""SELECT row_ord, CASE WHEN rating <= 2 THEN CASE WHEN similarity >= 0.28 THEN issue ELSE 'no_issue' END WHEN rating = 3 THEN CASE WHEN similarity >= 0.31 THEN issue ELSE 'no_issue' END
    WHEN named AND similarity >= 0.34 THEN issue ELSE 'no_issue' END AS prediction FROM (SELECT *, len(list_filter({_CUES}, lambda c: contains(lowered, c))) > 0 AS named FROM {_ROWS})""")
def _(s: SparkSession, d: str) -> DataFrame:
    """The evaluation's rule: cues as parts of words, no context; a good review without a cue has no issue."""
    named = F.exists(F.array(*[F.lit(c) for c in PROBLEM_CUES]), lambda c: F.contains(F.col("lowered"), c))
    least = F.when(F.col("rating") <= 2, 0.28).when(F.col("rating") == 3, 0.31).when(named, 0.34)
    return scored(s, d).select("row_ord", F.when(F.col("similarity") >= least, F.col("issue")).otherwise("no_issue").alias("prediction"))


_LEVEL = "CASE WHEN severity >= 25 THEN 'high' WHEN severity >= 15 THEN 'medium' WHEN severity > 0 THEN 'low' ELSE 'none' END"


@query("iss_severity_level", f"SELECT domain, issue, {_LEVEL} AS level FROM ({R._TAX_ROWS})")
def _(s: SparkSession, d: str) -> DataFrame:
    return issues.default_taxonomy(s).select("domain", "issue", issues.severity_level(F.col("severity")).alias("level"))


@query("iss_issue_text", f"SELECT domain, issue, replace(domain, '_', ' ') || ' issue: ' || label || '. Related terms: ' || array_to_string(keywords, ', ') AS value FROM ({R._TAX_ROWS})")
def _(s: SparkSession, d: str) -> DataFrame:
    """What a vector model would read for an issue."""
    x = issues.default_taxonomy(s)
    return x.select("domain", "issue", F.concat(F.replace("domain", F.lit("_"), F.lit(" ")), F.lit(" issue: "), "label", F.lit(". Related terms: "), F.array_join("keywords", ", ")).alias("value"))


@query("ret_issue_context", f"SELECT row_ord, CASE WHEN row_ord % 4 = 0 THEN '' ELSE label || '.' END AS value FROM {_ROWS}")
def _(s: SparkSession, d: str) -> DataFrame:
    """The words that stand for a review's issue when evidence is ranked; nothing where there is none."""
    issue = F.when(F.col("row_ord") % 4 == 0, "no_issue").otherwise(F.col("issue"))
    return scored(s, d).withColumn("issue", issue).select("row_ord", F.when(F.col("issue").isin("no_issue", "none", "not_available", "nan", ""), "").otherwise(F.concat("label", F.lit("."))).alias("value"))


@query("join_severity_lookup", f"SELECT row_ord, domain, issue, severity, {_LEVEL} AS level FROM {_ROWS}")
def _(s: SparkSession, d: str) -> DataFrame:
    """Severity by domain and issue, 0 where the taxonomy has none."""
    x = scored(s, d).select("row_ord", "domain", "issue")
    lookup = issues.default_taxonomy(s).select("domain", "issue", "severity")
    # a row per issue
    joined = x.join(F.broadcast(lookup), ["domain", "issue"], "left").withColumn("severity", F.coalesce("severity", F.lit(0)))
    return joined.select("row_ord", "domain", "issue", "severity", issues.severity_level(F.col("severity")).alias("level"))


@query("join_taxonomy_cross", f"""SELECT t.domain, issue, count(*) AS n FROM (SELECT CASE WHEN domain IN ('mobile_app', 'hotel', 'ecommerce', 'restaurant') THEN domain ELSE 'mobile_app' END AS domain FROM orchestrator_hotel_sample) r JOIN ({R._TAX_ROWS}) t USING (domain) GROUP BY 1, 2""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Each review meets every issue of its domain; how often each issue is met."""
    x = R.sample(s, d).select(issues.mining_domain(F.col("domain")).alias("domain"))
    return x.join(F.broadcast(issues.default_taxonomy(s).select("domain", "issue")), "domain").groupBy("domain", "issue").agg(F.count("*").alias("n"))


@query("flt_human_verified", f"""SELECT row_ord FROM (SELECT row_ord, domain, issue, ['yes', 'true', '1', 'verified', 'no', ' YES '][row_ord % 6 + 1] AS told, CASE WHEN row_ord % 5 = 0 THEN 'no_issue' WHEN row_ord % 7 = 0 THEN 'other' ELSE issue END AS named FROM {_ROWS})
    WHERE lower(trim(told)) NOT IN ('yes', 'true', '1', 'verified') OR (named <> 'no_issue' AND named <> issue)""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Rows of a labelled set that have to be rejected: not verified, or with an issue that its domain doesn't have."""
    told = F.element_at(F.array(*[F.lit(v) for v in ("yes", "true", "1", "verified", "no", " YES ")]), (F.col("row_ord") % 6 + 1).cast("int"))
    named = F.when(F.col("row_ord") % 5 == 0, "no_issue").when(F.col("row_ord") % 7 == 0, "other").otherwise(F.col("issue"))
    x = scored(s, d).select("row_ord", "domain", told.alias("told"), named.alias("named"))
    unverified = x.where(~F.lower(F.trim("told")).isin("yes", "true", "1", "verified"))
    known = issues.default_taxonomy(s).select("domain", F.col("issue").alias("named"))
    foreign = x.where("named <> 'no_issue'").join(F.broadcast(known), ["domain", "named"], "left_anti")
    return unverified.select("row_ord").union(foreign.select("row_ord")).distinct()


def q_window(x: str, phrases: str) -> str:
    bare = f"' ' || regexp_replace(lower({x}), '{R._EDGE}', ' ', 'g') || ' '"
    at = f"CASE WHEN coalesce({phrases}[1], '') = '' THEN 0 ELSE instr({bare}, ' ' || {phrases}[1] || ' ') END"
    return f"""(SELECT substring(CASE WHEN pos > 0 THEN trim(substring(x, lo, least(pos - 1 + length(word) + 90, length(x)) - lo + 1), ' ') ELSE coalesce({R.q_sentences('x')}[1], '') END, 1, 180)
        FROM (SELECT x, pos, word, greatest(pos - 70, 1) AS lo FROM (SELECT {x} AS x, {at} AS pos, coalesce({phrases}[1], '') AS word)))"""


@query("txt_evidence_window", f"SELECT row_ord, {q_window('squeezed', 'phrases')} AS value FROM (SELECT row_ord, {R.q_squeeze('review_text')} AS squeezed, list_transform(problem_cues, lambda k: {_AS_PHRASE}) AS phrases FROM {_ROWS})")
def _(s: SparkSession, d: str) -> DataFrame:
    phrases = F.transform("problem_cues", lambda k: F.btrim(F.regexp_replace(k, r"[^a-z0-9]+", " ")))
    return scored(s, d).select("row_ord", X.evidence_window(R.T(), phrases).alias("value"))


_FALLBACK = R.SQL["iss_fallback"]


@query("evl_rag", f"""SELECT count(*) AS issue_rows, round(avg(CASE WHEN row_ord % 3 = 0 THEN 0.0 ELSE 1.0 END) * 100, 2) AS with_evidence_percent, round(avg((row_ord % 71) / 100), 4) AS mean_similarity FROM ({_FALLBACK}) WHERE issue <> 'no_issue'""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Of the reviews with an issue, how many have evidence, and how alike it is. Each third review is taken to have none."""
    x = issues.mine(R.sample(s, d), issues.default_taxonomy(s)).where("issue <> 'no_issue'").withColumn("evidence", F.when(F.col("row_ord") % 3 == 0, " ").otherwise(F.col("cues")))
    return x.agg(F.count("*").alias("issue_rows"), F.round(F.avg((F.trim("evidence") != "").cast("double")) * 100, 2).alias("with_evidence_percent"), F.round(F.avg((F.col("row_ord") % 71) / 100), 4).alias("mean_similarity"))


@query("evl_issue_binary", f"""WITH c AS (SELECT domain, count(*) AS n, count(*) FILTER (truth AND found) AS tp, count(*) FILTER (NOT truth AND found) AS fp, count(*) FILTER (truth AND NOT found) AS fn, count(*) FILTER (NOT truth AND NOT found) AS tn
        FROM (SELECT s.row_ord, CASE WHEN domain IN ('mobile_app', 'hotel', 'ecommerce', 'restaurant') THEN domain ELSE 'mobile_app' END AS domain, {R.q_label('rating')} = 'negative' AS truth, f.issue <> 'no_issue' AS found FROM orchestrator_hotel_sample s JOIN ({_FALLBACK}) f USING (row_ord)) GROUP BY 1)
    SELECT domain, n, tp, fp, fn, tn, round((tp + tn) / n, 4) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 4) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 4) AS recall,
        round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1 FROM c""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Whether a review names an issue, against whether it is a bad one, by domain."""
    mined = issues.mine(R.sample(s, d), issues.default_taxonomy(s)).select("row_ord", (F.col("issue") != "no_issue").alias("found"))
    x = R.sample(s, d).select("row_ord", issues.mining_domain(F.col("domain")).alias("domain"), (X.rating_label(F.col("rating")) == "negative").alias("truth")).join(mined, "row_ord")
    t, f = F.col("truth"), F.col("found")
    c = x.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(t & f).alias("tp"), F.count_if(~t & f).alias("fp"), F.count_if(t & ~f).alias("fn"), F.count_if(~t & ~f).alias("tn"))
    part = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(a / b), 4)
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return c.select("domain", "n", "tp", "fp", "fn", "tn", F.round((tp + tn) / F.col("n"), 4).alias("accuracy"), part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query("dedup_priority_union", f"""WITH x AS (SELECT s.row_ord, s.review_id, CASE WHEN s.rating <= 2 THEN 0 WHEN s.rating >= 4.5 AND f.issue <> 'no_issue' THEN 1 WHEN f.issue <> 'no_issue' THEN 2 ELSE 3 END AS tier FROM orchestrator_hotel_sample s JOIN ({_FALLBACK}) f USING (row_ord))
    SELECT review_id, tier, row_ord FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY tier, row_ord) AS rn FROM x) WHERE rn = 1 ORDER BY tier, row_ord LIMIT 20""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Examples in the order of four tiers (bad, at odds with its rating, with an issue, any), each id once."""
    mined = issues.mine(R.sample(s, d), issues.default_taxonomy(s)).select("row_ord", "issue")
    x = R.sample(s, d).select("row_ord", "review_id", "rating").join(mined, "row_ord")
    named = F.col("issue") != "no_issue"
    x = x.withColumn("tier", F.when(F.col("rating") <= 2, 0).when((F.col("rating") >= 4.5) & named, 1).when(named, 2).otherwise(3))
    once = x.groupBy("review_id").agg(F.min(F.struct("tier", "row_ord")).alias("r"))
    return once.select("review_id", "r.tier", "r.row_ord").orderBy("tier", "row_ord").limit(20)


@query("dedup_issue_examples", f"""WITH x AS (SELECT s.row_ord, s.review_id, coalesce(s.rating, 999.0) AS standing, CASE WHEN f.issue <> 'no_issue' AND f.severity >= 25 THEN 0 WHEN f.issue <> 'no_issue' THEN 1 WHEN s.rating <= 2 THEN 2 ELSE 3 END AS tier FROM orchestrator_hotel_sample s JOIN ({_FALLBACK}) f USING (row_ord))
    SELECT review_id, tier, row_ord FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY tier, standing, row_ord) AS rn FROM x) WHERE rn = 1 ORDER BY tier, standing, row_ord LIMIT 4""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Four examples: grave issues first, then issues, then bad reviews, then any; in a tier the lowest rating first; each id once."""
    mined = issues.mine(R.sample(s, d), issues.default_taxonomy(s)).select("row_ord", "issue", "severity")
    x = R.sample(s, d).select("row_ord", "review_id", "rating").join(mined, "row_ord")
    named = F.col("issue") != "no_issue"
    x = x.withColumns({"tier": F.when(named & (F.col("severity") >= 25), 0).when(named, 1).when(F.col("rating") <= 2, 2).otherwise(3), "standing": F.coalesce("rating", F.lit(999.0))})
    once = x.groupBy("review_id").agg(F.min(F.struct("tier", "standing", "row_ord")).alias("r")).select("review_id", "r.*")
    return once.orderBy("tier", "standing", "row_ord").limit(4).select("review_id", "tier", "row_ord")


@query("agg_top_issues", f"""WITH c AS (SELECT entity_id, issue, count(*) AS n FROM orchestrator_hotel_sample JOIN ({_FALLBACK}) USING (row_ord) WHERE issue <> 'no_issue' GROUP BY 1, 2),
    t AS (SELECT entity_id, string_agg(issue || ' (' || n || ')', '; ' ORDER BY rn) AS top FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, issue) AS rn FROM c) WHERE rn <= 5 GROUP BY 1)
    SELECT e.entity_id, coalesce(top, 'none') AS top_issues FROM (SELECT DISTINCT entity_id FROM orchestrator_hotel_sample) e LEFT JOIN t ON e.entity_id IS NOT DISTINCT FROM t.entity_id""")
def _(s: SparkSession, d: str) -> DataFrame:
    """The five most frequent issues of each entity with their numbers; none where there is no issue."""
    mined = issues.mine(R.sample(s, d), issues.default_taxonomy(s)).where("issue <> 'no_issue'").select("row_ord", "issue")
    every = R.sample(s, d).select("row_ord", "entity_id")
    counts = every.join(mined, "row_ord").groupBy("entity_id", "issue").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("n"), "issue"))
    five = counts.withColumn("place", place).where("place <= 5")
    items = F.sort_array(F.collect_list(F.struct("place", F.concat("issue", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t"))))
    top = five.groupBy(F.col("entity_id").alias("e")).agg(F.array_join(F.transform(items, lambda i: i["t"]), "; ").alias("top"))
    return every.select("entity_id").distinct().join(top, F.col("entity_id").eqNullSafe(F.col("e")), "left").select("entity_id", F.coalesce("top", F.lit("none")).alias("top_issues"))


# ---- scores from vectors: four segments a review, six issues a group

_V = "CAST(embedding AS DOUBLE[])"
_SEG = f"(SELECT vec_id // 4 AS review, (vec_id // 4) % 4 AS grp, vec_id % 4 AS segment, {_V} AS vec FROM embeddings)"
_ISS = f"(SELECT vec_id AS issue, vec_id % 4 AS grp, {_V} AS issue_vec FROM embeddings WHERE vec_id < 24)"
_SCORES = f"""(SELECT review, issue, max(s) AS similarity, max(CASE WHEN segment = 0 THEN s END) AS whole, first(segment ORDER BY s DESC, segment) AS segment
    FROM (SELECT review, segment, issue, list_dot_product(vec, issue_vec) AS s FROM {_SEG} JOIN {_ISS} USING (grp)) GROUP BY 1, 2)"""
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY review ORDER BY similarity DESC, issue) AS place FROM {_SCORES})"
#: Least similarity of these vectors, which no model made.
_STANDARD = 0.1


def scores(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings")
    review = F.floor(F.col("vec_id") / 4)
    segments = v.select(review.alias("review"), (review % 4).alias("grp"), (F.col("vec_id") % 4).alias("segment"), F.col("embedding").alias("vec"))
    # twenty-four rows
    named = v.where("vec_id < 24").select(F.col("vec_id").alias("issue"), (F.col("vec_id") % 4).alias("grp"), F.col("embedding").alias("issue_vec"))
    return issues.issue_scores(segments, named)


@query("iss_score", f"SELECT review, issue, round(similarity, 4) AS similarity, round(whole, 4) AS whole FROM {_SCORES}")
def _(s: SparkSession, d: str) -> DataFrame:
    return scores(s, d).select("review", "issue", F.round("similarity", 4).alias("similarity"), F.round("whole", 4).alias("whole"))


@query("win_max_segment", f"SELECT review, issue, segment FROM {_SCORES}")
def _(s: SparkSession, d: str) -> DataFrame:
    return scores(s, d).select("review", "issue", "segment")


@query("win_top1_top2_margin", f"SELECT review, max(CASE WHEN place = 1 THEN issue END) AS issue, round(max(CASE WHEN place = 1 THEN similarity END), 4) AS best, round(max(CASE WHEN place = 1 THEN similarity END) - max(CASE WHEN place = 2 THEN similarity END), 4) AS margin FROM {_RANKED} GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    """The best issue of a review and how far it is ahead of the second."""
    at = lambda c, k: F.max(F.when(F.col("place") == k, F.col(c)))
    x = issues.ranked_issues(scores(s, d)).where("place <= 2").groupBy("review")
    return x.agg(at("issue", 1).alias("issue"), F.round(at("similarity", 1), 4).alias("best"), F.round(at("similarity", 1) - at("similarity", 2), 4).alias("margin"))


@query("iss_top_matches", f"SELECT review, issue, place FROM {_RANKED} WHERE similarity >= {_STANDARD} AND place <= 3")
def _(s: SparkSession, d: str) -> DataFrame:
    return issues.ranked_issues(scores(s, d)).where((F.col("similarity") >= _STANDARD) & (F.col("place") <= 3)).select("review", "issue", "place")


@query("iss_detected_list", f"SELECT review, string_agg(issue || ':' || printf('%.3f', similarity), '; ' ORDER BY place) AS detected FROM {_RANKED} WHERE place <= 3 AND (place = 1 OR similarity >= {_STANDARD}) GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return issues.detected(issues.ranked_issues(scores(s, d)), _STANDARD)


# ---- evidence with the weight of an issue, exclusions and outputs

_EV = f"(SELECT vec_id, label % 4 AS g, label, md5(CAST(vec_id // 2 AS VARCHAR)) AS hash, vec_id % 7 AS entity, {_V} AS vec FROM embeddings)"
_EVIDENCE = f"""q AS (SELECT vec_id AS q_id, g, label, hash, entity, vec FROM {_EV} WHERE vec_id % 50 = 0), c AS (SELECT vec_id AS c_id, g, hash AS c_hash, entity AS c_entity, vec AS c_vec FROM {_EV}),
    i AS (SELECT g, first(vec ORDER BY vec_id) AS issue_vec FROM {_EV} GROUP BY 1),
    s AS (SELECT q_id, c_id, label, hash, c_hash, entity, c_entity, list_dot_product(vec, c_vec) AS own, list_dot_product(c_vec, issue_vec) AS with_issue FROM q JOIN c USING (g) JOIN i USING (g)),
    p AS (SELECT *, 0.9 * own + 0.1 * with_issue AS score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(own, 4) DESC, c_id) AS place FROM s) WHERE place <= 80),
    f AS (SELECT * FROM p WHERE c_id <> q_id AND hash <> c_hash AND entity <> c_entity AND round(score, 4) >= {{least}}),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id, c_hash ORDER BY round(score, 4) DESC, c_id) AS again FROM f) WHERE again = 1),
    e AS (SELECT q_id, label, c_id, c_hash, round(score, 4) AS score, round(own, 4) AS own, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 4) DESC, c_id) AS rank FROM o) WHERE rank <= 3)"""
_E = _EVIDENCE.replace("{least}", "0.05")


def evidence(s: SparkSession, d: str) -> DataFrame:
    """The queries are every row whose id is divisible by 50, against all rows."""
    v = table(s, d, "embeddings").select("vec_id", (F.col("label") % 4).alias("g"), "label", F.md5(F.floor(F.col("vec_id") / 2).cast("string")).alias("hash"), (F.col("vec_id") % 7).alias("entity"), F.col("embedding").alias("vec"))
    # a row per group
    issue = v.groupBy("g").agg(F.min_by("vec", "vec_id").alias("issue_vec"))
    queries = v.where("vec_id % 50 = 0").withColumnsRenamed({"vec_id": "q_id"})
    return retrieval.ranked_evidence(queries, v.withColumnsRenamed({"vec_id": "c_id"}).drop("label"), issue, "g", least=0.05)


@query("ret_rerank", f"WITH {_E} SELECT q_id, c_id, score, own, rank FROM e")
def _(s: SparkSession, d: str) -> DataFrame:
    """Nine parts of the review's likeness and one of its issue's; never itself, an equal text or the same entity."""
    return evidence(s, d).select("q_id", "c_id", "score", "own", "rank")


@query("ret_exclusions", f"WITH {_EVIDENCE.replace("{least}", "0.30")} SELECT q_id, c_id, score, rank FROM e")
def _(s: SparkSession, d: str) -> DataFrame:
    """As ret_rerank, with the least similarity that is in use."""
    v = table(s, d, "embeddings").select("vec_id", (F.col("label") % 4).alias("g"), "label", F.md5(F.floor(F.col("vec_id") / 2).cast("string")).alias("hash"), (F.col("vec_id") % 7).alias("entity"), F.col("embedding").alias("vec"))
    issue = v.groupBy("g").agg(F.min_by("vec", "vec_id").alias("issue_vec"))
    return retrieval.ranked_evidence(v.where("vec_id % 50 = 0").withColumnsRenamed({"vec_id": "q_id"}), v.withColumnsRenamed({"vec_id": "c_id"}).drop("label"), issue, "g").select("q_id", "c_id", "score", "rank")


@query("ret_row_outputs", f"""WITH {_E} SELECT q.vec_id AS q_id, coalesce(max(CASE WHEN rank = 1 THEN score END), 0.0) AS top_score, coalesce(CAST(max(CASE WHEN rank = 1 THEN c_id END) AS VARCHAR), '') AS top_id, count(c_id) AS found, count(c_id) > 0 AS available
    FROM (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0) q LEFT JOIN e ON q.vec_id = e.q_id GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    """A row per query: its best evidence and how many there are; empty values where there is none."""
    found = evidence(s, d).groupBy("q_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s"), F.max(F.when(F.col("rank") == 1, F.col("c_id"))).alias("c"), F.count("*").alias("n"))
    every = table(s, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"))
    n = F.coalesce("n", F.lit(0))
    return every.join(found, "q_id", "left").select("q_id", F.coalesce("s", F.lit(0.0)).alias("top_score"), F.coalesce(F.col("c").cast("string"), F.lit("")).alias("top_id"), n.alias("found"), (n > 0).alias("available"))


@query("ret_issue_evidence", f"""WITH {_E}, b AS (SELECT label AS issue, c_id, row_number() OVER (PARTITION BY label, c_hash ORDER BY q_id, rank) AS again, q_id, rank FROM e)
    SELECT issue, c_id, place FROM (SELECT issue, c_id, row_number() OVER (PARTITION BY issue ORDER BY q_id, rank) AS place FROM b WHERE again = 1) WHERE place <= 3""")
def _(s: SparkSession, d: str) -> DataFrame:
    """For each issue (here the queries' label) its first three pieces of evidence, each text once, in the order in which they were found."""
    return retrieval.bucketed(evidence(s, d), "label", 3).select(F.col("label").alias("issue"), "c_id", "place")


@query("win_issue_bucket", f"""WITH {_E}, b AS (SELECT label AS issue, row_number() OVER (PARTITION BY label, c_hash ORDER BY q_id, rank) AS again FROM e) SELECT issue, least(count(*), 3) AS kept, count(*) AS different FROM b WHERE again = 1 GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    """How many different texts each issue found, and how many of them its bucket keeps."""
    x = evidence(s, d).groupBy("label").agg(F.count_distinct("c_hash").alias("different"))
    return x.select(F.col("label").alias("issue"), F.least("different", F.lit(3)).alias("kept"), "different")
