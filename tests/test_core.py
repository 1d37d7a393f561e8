"""Operators of the core on small fixtures."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from loupe.functions import text as X
from loupe.functions.timestamps import normalise_timestamps
from loupe.operators import dedup, issues, retrieval, sampling, scoring, standardise, summaries
from loupe.sources import readers, writers
from loupe.streaming import reviews as streaming


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


# ---- timestamps

PROFILES = [("ny", "America/New_York", "mdy"), ("ldn", "Europe/London", "dmy"), ("none", None, None), ("ny", "Asia/Tokyo", "mdy"), (None, "UTC", "dmy")]


def stamps(spark, rows, **policy):
    profiles = spark.createDataFrame(PROFILES, "source string, zone_name string, date_order string")
    df = spark.createDataFrame([(i, v, s, "x") for i, (v, s) in enumerate(rows)], "row_ord long, review_date string, source string, zone_name string")
    out = normalise_timestamps(df, profiles, **policy)
    assert out.columns == [*df.columns, "review_ts_utc", "review_ts_utc_status"]
    return [(r["review_ts_utc"], r["review_ts_utc_status"]) for r in out.orderBy("row_ord").collect()]


@pytest.mark.parametrize(
    ("value", "source", "instant", "status"),
    [
        ("2021-07-01 10:00:00", "ny", "2021-07-01T14:00:00.000000Z", "ok"),
        (" 07/01/2021 ", "ny", "2021-07-01T04:00:00.000000Z", "ok"),
        ("07/01/2021", "ldn", "2021-01-07T00:00:00.000000Z", "ok"),
        ("13/01/2021", "ny", None, "impossible"),
        ("01.02.2021 5:06", "ldn", "2021-02-01T05:06:00.000000Z", "ok"),
        ("12/31/2021 12:05 AM", "ny", "2021-12-31T05:05:00.000000Z", "ok"),
        ("12/31/2021 13:05 PM", "ny", None, "impossible"),
        ("Wed, 06 Jan 2016 09:17:15 +0530", None, "2016-01-06T03:47:15.000000Z", "ok"),
        ("Thu, 06 Jan 2016 09:17:15 +0000", None, None, "impossible"),
        ("2016-01-05T13:39:24.012811-05:00", None, "2016-01-05T18:39:24.012811Z", "ok"),
        ("20160110T120251Z", None, "2016-01-10T12:02:51.000000Z", "ok"),
        ("2016-01-10 12:02:51 Mars/Olympus", None, None, "impossible"),
        ("January 9, 2016 1:55 AM", "ny", "2016-01-09T06:55:00.000000Z", "ok"),
        ("1452909937009599", None, "2016-01-16T02:05:37.009599Z", "ok"),
        ("1452223171", None, "2016-01-08T03:19:31.000000Z", "ok"),
        ("2021-02-29", "ny", None, "impossible"),
        ("2021-11-07 01:30:00", "ny", None, "ambiguous"),
        ("2021-03-14 02:30:00", "ny", None, "nonexistent"),
        ("2021-11-07 01:30:00 America/New_York", "ldn", None, "ambiguous"),
        ("2021-07-01", "none", None, "no_zone"), ("7/1/2021", "none", None, "no_order"), ("7/1/2021", None, None, "no_order"),
        ("2021-07-01", "unknown", None, "no_zone"),
        (None, "ny", None, "missing"), ("  ", "ny", None, "missing"), ("2 weeks ago", "ny", None, "relative"), ("Edited 3 days ago", "ny", None, "relative"),
        ("2021-07-01 10:00:00+02", "ny", "2021-07-01T08:00:00.000000Z", "ok"), ("2021/07/01 10:00", "ldn", "2021-07-01T09:00:00.000000Z", "ok"),
        ("-1452223171", None, "1923-12-25T20:40:29.000000Z", "ok"), ("999999999999", None, "2001-09-09T01:46:39.999000Z", "ok"),
        ("March 2021", "ny", None, "partial"), ("n/a", "ny", None, "unknown_format"), ("x" * 100_000, "ny", None, "unknown_format"),
    ],
)
def test_timestamp(spark, value, source, instant, status):
    assert stamps(spark, [(value, source)]) == [(instant, status)]


def test_timestamp_policies_and_empty(spark):
    rows = [("2021-11-07 01:30:00", "ny"), ("2021-03-14 02:30:00", "ny")]
    assert stamps(spark, rows, ambiguous="earlier", nonexistent="forward") == [("2021-11-07T05:30:00.000000Z", "ok"), ("2021-03-14T07:30:00.000000Z", "ok")]
    assert stamps(spark, rows, ambiguous="later")[0] == ("2021-11-07T06:30:00.000000Z", "ok")
    assert stamps(spark, rows[:0]) == []
    with pytest.raises(ValueError):
        stamps(spark, rows, ambiguous="guess")


def test_timestamps_around_changes_match_zoneinfo(spark):
    rows, want = [], []
    for zone, source in (("America/New_York", "ny"), ("Europe/London", "ldn")):
        for start in (dt.datetime(2022, 3, 12), dt.datetime(2022, 3, 26), dt.datetime(2022, 10, 29), dt.datetime(2022, 11, 5)):
            for k in range(96):
                local = start + dt.timedelta(minutes=30 * k)
                found = {local.replace(tzinfo=ZoneInfo(zone), fold=f).astimezone(dt.timezone.utc) for f in (0, 1)}
                found = {u for u in found if u.astimezone(ZoneInfo(zone)).replace(tzinfo=None) == local}
                rows.append((local.strftime("%Y-%m-%d %H:%M:%S"), source))
                want.append(found.pop().strftime("%Y-%m-%dT%H:%M:%S.%fZ") if len(found) == 1 else None)
    assert [a for a, _ in stamps(spark, rows)] == want


# ---- text, ratings, labels


def test_text_functions(spark):
    assert values(spark, ["<b>Hi</b> see https://x.y/z  now", None], X.without_markup) == ["Hi see now", ""]
    assert values(spark, ["Room 12, was GREAT!! www.a.b", ""], X.clean_text) == ["room was great", ""]
    assert values(spark, ["a b  c", "", None], X.word_count) == [3, 0, 0]
    assert values(spark, ["No Negative", "fine", "n/a", "nothing", "None"], X.placeholder_to_empty) == ["", "fine", "n/a", "nothing", ""]
    assert values(spark, ["bad app", "an ad here"], lambda c: X.has_phrase(c, F.lit("ad"))) == [False, True]
    assert values(spark, ["Mobile-App", "HOTELS ", "mixed", None], X.known_domain) == ["mobile_app", "hotel", None, None]


def test_ratings_and_labels(spark):
    assert values(spark, ["9", "x", None, "0", "4.5", "NaN"], X.safe_rating) == [4.5, 3.0, 3.0, 1.0, 4.5, 3.0]
    assert values(spark, ["9", "x", "0.2"], X.clipped_rating) == [5.0, None, 1.0]
    assert values(spark, [2.5, 3.0, 3.9, 4.0, None], X.rating_label, "double") == ["neutral", "neutral", "neutral", "positive", "neutral"]
    assert values(spark, [2.5, 3.0, 3.9, 4.0, 1.0], X.strict_rating_label, "double") == [None, "neutral", None, "positive", "negative"]


def test_sentences_segments_and_windows(spark):
    assert values(spark, ["One. Two!  Three\nfour", None], X.sentences) == [["One.", "Two!", "Three", "four"], []]
    got = values(spark, ["Good food but slow staff. good FOOD, one", ""], X.segments)
    assert got == [["Good food but slow staff. good FOOD, one", "Good food but slow staff.", "Good food", "slow staff.", "good FOOD, one"], [""]]
    text = "x" * 100 + " the room was dirty " + "y" * 200
    window = values(spark, [text], lambda c: X.evidence_window(c, F.array(F.lit("dirty"))))[0]
    assert "dirty" in window and len(window) == 70 + 5 + 90
    assert values(spark, ["First one. Second"], lambda c: X.evidence_window(c, F.array().cast("array<string>"))) == ["First one."]
    names = [("Café Rouge", "cafe rouge"), ("Café Rouge", "CAFÉ, rouge"), ("Rouge", "Café Rouge"), ("a b", "b c"), (None, "a")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(names)], "i int, a string, b string").orderBy("i")
    assert [r[0] for r in df.select(X.name_match(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.82, 0.5, 0.0]


def test_contexts_and_decisions(spark):
    rows = ["I want science but not shameful pictures", "this app has no sexual content at all", "please stop the sexual content", "plain"]
    cues = F.array(F.lit("sexual content"), F.lit("shameful pictures"))
    assert values(spark, rows, lambda c: issues.complaint_context(c, cues)) == [True, False, True, False]
    assert values(spark, rows, lambda c: issues.protective_context(c, cues)) == [False, True, False, False]
    held = "rating double, sentiment string, similarity double, second double, problem boolean, cues array<string>, complaint boolean, protective boolean"
    cases = [
        (5.0, "positive", 0.9, 0.1, False, [], False, False, "positive_no_problem_block"), (5.0, "positive", 0.9, 0.1, True, ["ad"], False, True, "protective_absence_context"),
        (1.0, "negative", 0.27, 0.1, True, [], False, False, "semantic_threshold"), (1.0, "negative", 0.20, 0.1, True, ["ad"], False, False, "semantic_plus_taxonomy_cue"),
        (1.0, "negative", 0.20, 0.19, True, ["ad"], False, False, "below_threshold"),
    ]
    x = spark.createDataFrame([c[:-1] for c in cases], held)
    x = x.withColumn("standard", issues.threshold(F.lit("mobile_app"), F.col("rating"), F.col("sentiment"), F.col("problem")))
    assert [r["reason"] for r in issues.decided(x).collect()] == [c[-1] for c in cases]


def test_ranks_without_gathering_a_group(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "a") for i in range(100)], "row_ord long, g string")
    got = {r["row_ord"]: r["i"] for r in sampling.ranked(df, ["g"], ["row_ord"], F.floor(F.col("row_ord") / 7), "i").collect()}
    assert got == {r: sum(1 for q in range(r + 1) if (q % 3 == 0) == (r % 3 == 0)) for r in range(100)}
    places = [r["place"] for r in sampling.shuffled(df, "row_ord").orderBy("row_ord").collect()]
    assert sorted(places) == list(range(1, 101)) and places != sorted(places)
    with pytest.raises(ValueError):
        sampling.exactly_per_group(df, "g", "row_ord", 50)


# ---- operators


def test_standardise(spark):
    df = spark.createDataFrame([("H", "No Positive", "bad  room", 2.0, None, "d"), ("H", "good", "No Negative", 10.0, None, "d"), ("H", "", None, None, 7.0, "d")], "hotel_name string, positive_review string, negative_review string, reviewer_score double, average_score double, review_date string")
    assert [(r["review_text"], r["rating"]) for r in standardise.hotel(df).collect()] == [("bad room", 1.0), ("good", 5.0)]
    assert standardise.conform(df).columns == standardise.COMMON.fieldNames()
    assert standardise.detect_domain(["Content", "Score"]) == "mobile_app"
    assert standardise.detect_domain(["domain"], {"hotel", "ecommerce"}) == "multidomain"
    # columns that tell nothing are no error: the rows name their domains
    assert standardise.detect_domain(["a"]) == "multidomain"
    with pytest.raises(ValueError):
        standardise.standardise(df, "books")


def test_shops_and_meals(spark):
    shop = spark.createDataFrame([(1, "9", "Five stars", "good  cream", None, "p"), (2, "x", None, None, "a", None), (3, None, "t", " ", "a", None)], "row_ord long, rating string, title string, text string, asin string, parent_asin string").withColumn("timestamp", F.lit("t"))
    assert [(r["review_id"], r["entity_id"], r["review_text"], r["rating"]) for r in standardise.shop(shop).collect()] == [("ecommerce_1", "p", "good cream", 4.5)]
    assert [(r["review_text"], r["rating"]) for r in standardise.shop_joined(shop).collect()] == [("Five stars. good cream", 5.0)]
    meals = spark.createDataFrame([(1, "u", "2", "d", "cold soup"), (2, None, None, None, None)], ["row_ord", "Yelp URL", "Rating", "Date", "Review Text"])
    assert [(r["entity_id"], r["rating"]) for r in standardise.restaurant(meals).collect()] == [("u", 2.0)]
    assert standardise.standardise(meals, "restaurant").columns == standardise.COMMON.fieldNames()
    common = spark.createDataFrame([(2, "Product", "e", "same"), (1, "ecommerce", "e", "same "), (3, "books", "e", "x")], "row_ord long, domain string, entity_id string, review_text string")
    kept = standardise.already_common(common).collect()
    assert [(r["row_ord"], r["domain"], r["rating"]) for r in kept] == [(1, "ecommerce", 3.0)] and set(standardise.COMMON.fieldNames()) < set(kept[0].asDict())


def test_dedup(spark):
    df = spark.createDataFrame([("A", "pos", 1), ("A", "neg", 2), ("B", "pos", 4), ("B", "pos", 3), (None, "pos", 5)], "k string, label string, row_ord long")
    assert {(r["k"], r["row_ord"]) for r in dedup.without_conflicts(df, "k", "label", "row_ord").collect()} == {("B", 3), (None, 5)}
    assert dedup.conflict_audit(df, "k", "label").first().asDict() == {"input_rows": 5, "conflicting_keys": 1, "conflicting_rows": 2, "duplicate_rows": 1, "output_rows": 2}
    assert {r["row_ord"] for r in dedup.first_by(df, ["k"], "row_ord").collect()} == {1, 3, 5}
    assert dedup.first_by(df.where("false"), ["k"], "row_ord").count() == 0


def test_round_robin_takes_turns(spark):
    df = spark.createDataFrame([(i, "a" if i == 0 else "b" if i < 11 else "c") for i in range(21)], "row_ord long, g string")
    got = sampling.round_robin(df, "g", "row_ord", 9).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {"a": 1, "b": 4, "c": 4}
    assert sampling.round_robin(df, "g", "row_ord", 0).count() == 21
    assert sampling.stratified_split(df, ["g"], "row_ord", 0.15).where("is_validation").count() == 4


def test_summaries(spark):
    df = spark.createDataFrame([("pos", "pos"), ("pos", "neg"), ("neg", "neg"), (None, "pos")], "actual string, predicted string")
    got = {r["label"]: (r["support"], r["precision"], r["recall"]) for r in summaries.precision_recall(df, "actual", "predicted", ["pos", "neg", "neu"]).collect()}
    assert got == {"pos": (2, 0.5, 0.5), "neg": (1, 0.5, 1.0), "neu": (0, 0.0, 0.0)}


def test_issues(spark):
    rows = [(1, "mobile_app", "The app keeps crash on login"), (2, "hotel", "Lovely quiet stay"), (3, "unknown", "payment was charged"), (4, "hotel", None)]
    got = {r["row_ord"]: (r["issue"], r["severity"]) for r in issues.mine(spark.createDataFrame(rows, "row_ord long, domain string, review_text string"), issues.default_taxonomy(spark)).collect()}
    assert got == {1: ("crash", 25), 2: ("no_issue", 0), 3: ("payment", 25), 4: ("no_issue", 0)}
    rows = [(1, "mobile_app", "It won't open. Force  close!"), (2, "mobile_app", "shows adult content")]
    got = {r["row_ord"]: (r["issue"], r["issues"]) for r in issues.mine(spark.createDataFrame(rows, "row_ord long, domain string, review_text string"), issues.default_taxonomy(spark)).collect()}
    assert got == {1: ("crash", "crash"), 2: ("inappropriate_content", "inappropriate_content")}


def test_retrieval_excludes_itself_and_equal_texts(spark):
    rows = [(i, 0, f"h{i // 2}", [1.0, float(i)]) for i in range(10)]
    v = spark.createDataFrame(rows, "id long, g int, hash string, vec array<double>").withColumn("vec", retrieval.unit(F.col("vec")))
    got = retrieval.top_evidence(v.withColumnRenamed("id", "q_id"), v.withColumnRenamed("id", "c_id"), "g", k=2).collect()
    assert len(got) == 20 and all(r["q_id"] // 2 != r["c_id"] // 2 for r in got)


def test_scorers(spark):
    rows = [(i, ("good lovely stay" if i % 2 else "bad dirty room") + f" w{i % 7}", "positive" if i % 2 else "negative") for i in range(60)] + [(90, None, None), (91, "", None)]
    x = spark.createDataFrame(rows, "id long, text string, label string")
    model, labels = scoring.train_labels(x)
    got = {r["id"]: r for r in scoring.label_scorer(model, labels)(x).collect()}
    assert labels == ["negative", "positive"] and len(got) == len(rows)
    assert all(got[i]["label"] == label and got[i]["confidence"] > 0.5 for i, _, label in rows[:60])
    vectors = {r["id"]: r["vec"] for r in scoring.vector_scorer(32)(x).collect()}
    assert abs(sum(v * v for v in vectors[1]) - 1) < 1e-5 and set(vectors[91]) == {0.0}
    registry = scoring.Registry()
    registry.add("embed", scoring.vector_scorer(8))
    assert registry.missing(["star", "embed"]) == ["star"]
    with pytest.raises(KeyError):
        registry.get("star", fallback=scoring.vector_scorer(8))
    assert scoring.Registry(strict=False).get("star", fallback=len) is len


def test_tables_are_built_once(spark, tmp_path):
    folder, built = str(tmp_path / "corpus"), []

    def build():
        built.append(1)
        return spark.range(3)

    assert [writers.load_or_build(spark, folder, sign, build)[1] for sign in ("a", "a", "b")] == [True, False, True] and len(built) == 2
    assert writers.contract_fault(spark.range(1), ["id", "x"]) == "missing columns: x" and writers.contract_fault(spark.range(1), ["id"]) == ""


# ---- sources, sinks, streams


def test_csv_encodings_and_missing(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿name,review_text\n"Caf\xe9","two\nlines"\nNA,x\n'.encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("name,review_text\nCafé,x\n".encode("latin-1"))
    a = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert a.columns == ["name", "review_text"] and a.collect()[0].asDict() == {"name": "Café", "review_text": "two\nlines"}
    assert readers.read_csv(spark, str(tmp_path / "b.csv")).first()["name"] == "Café"
    (tmp_path / "c.csv").write_bytes("name,review_text\nCafé \ufffd,x\n".encode())
    assert readers.read_csv(spark, str(tmp_path / "c.csv"), multi_line=False).first()["name"] == "Café \ufffd"
    assert {r["name"] for r in readers.read_csv(spark, str(tmp_path / "[bc].csv")).collect()} == {"Café", "Café \ufffd"}
    assert readers.missing_to_null(a).where("name IS NULL").count() == 1
    assert readers.single_review(spark, " fine, really ", 4, "hotel").first()["review_text"] == "fine, really"


def test_input_kinds(spark):
    got = values(spark, ["x.CSV", "https://play.google.com/store/apps/details?id=a.b", "https://www.google.com/maps/place/x", "com.some.app", "nice stay", "https://user@google.com/maps"], readers.input_kind)
    assert got == ["csv", "play_url", "maps_url", "app_id", "text", "text"]
    assert values(spark, ["https://play.google.com/store/apps/details?id=a.b&hl=en", "a.b.c", "none here"], readers.app_id) == ["a.b", "a.b.c", None]


def test_runs(spark, tmp_path):
    folder = str(tmp_path / "runs" / "one")
    assert writers.latest_run(spark, str(tmp_path / "runs")) is None
    writers.write_run({"t": spark.range(3)}, folder, {"rows": 3})
    assert writers.read_manifest(spark, folder) == {"rows": 3, "tables": ["t"]}
    assert writers.latest_run(spark, str(tmp_path / "runs")).endswith("/one")


def test_streaming(spark, tmp_path):
    rows = [("a", 5, dt.datetime(2024, 1, 1, 0, 1)), ("a", 5, dt.datetime(2024, 1, 1, 0, 2)), ("b", 1, dt.datetime(2024, 1, 1, 0, 12)), ("c", 3, dt.datetime(2024, 1, 1, 3, 0))]
    spark.createDataFrame(rows, "content string, score int, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("content string, score int, at timestamp").parquet(str(tmp_path / "in"))
    q = streaming.distinct_within(stream, ["content"], "at", "1 hour").writeStream.format("memory").queryName("distinct_reviews").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["content"] for r in spark.table("distinct_reviews").collect()) == ["a", "b", "c"]
    q = streaming.label_windows(stream, "at", "10 minutes", "10 minutes").writeStream.format("memory").outputMode("complete").queryName("label_windows").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["label"], r["n"]) for r in spark.table("label_windows").collect()} == {("positive", 2), ("negative", 1), ("neutral", 1)}


def test_entry_needs_no_session_and_core_stands_alone():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"p4_found", "std_hotel", "agg_entity_summary"} <= names
    assert set(entry.oracle_sql()) <= names
