"""Queries of problem 4, mixed timestamp formats and time zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.functions.timestamps import CASCADE, EPOCH, MONTHS, PARTIAL, RELATIVE, normalise_timestamps
from loupe.session import table


def p4_normalised(spark: SparkSession, folder: str) -> DataFrame:
    """Every review with its instant, or the reason why it has none."""
    sample = table(spark, folder, "orchestrator_hotel_sample").select("row_ord", "review_date", "source")
    return normalise_timestamps(sample, table(spark, folder, "source_profiles"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_normalised(spark, folder).where(F.col("review_ts_utc").isNotNull()).select("row_ord", "review_ts_utc")


def _sql(columns: str, where: str) -> str:
    """The same in SQL: time zones come from DuckDB's own tables."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    v = "trim(regexp_replace(review_date, '[\\s\\x0B\\p{Z}]+', ' ', 'g'))"
    form = "CASE " + " ".join(f"WHEN regexp_matches(v, {quoted(p)}) THEN '{n}'" for n, p, _ in CASCADE) + " END"
    # DuckDB gives nine groups at most, so the weekday's is left out where a later one is asked for
    group = lambda p, g: f"regexp_extract(v, {quoted(p.replace('(?:([A-Za-z]{3}), )?', '(?:[A-Za-z]{3}, )?'))}, {g - 1})" if p.startswith("^(?:([A-Za-z]{3})") and g > 1 else f"regexp_extract(v, {quoted(p)}, {g})"
    part = lambda i: "CASE form " + " ".join(f"WHEN '{n}' THEN " + (group(p, g[i]) if g[i] else "''") for n, p, g in CASCADE) + " END"
    parts = ", ".join(f"{part(i)} AS {name}" for i, name in enumerate(("y", "mo", "d", "h", "mi", "se", "fr", "half", "z", "wd")))
    number = lambda x: f"CASE WHEN {x} = '' THEN 0 ELSE try_cast({x} AS INTEGER) END"
    month = f"CASE WHEN regexp_matches(mo, '^\\d') THEN try_cast(mo AS INTEGER) ELSE coalesce(nullif(list_position({MONTHS}, lower(mo)), 0), list_position({[m[:3] for m in MONTHS]}, lower(mo))) END"
    swap = "(form = 'slashed' AND date_order = 'dmy')"
    offset = lambda at: f"(epoch_us(timezone(named, to_timestamp(floor(({at}) / 1000000)))) - CAST(floor(({at}) / 1000000) AS BIGINT) * 1000000)"
    return f"""
        WITH b AS (SELECT row_ord, review_date, s.source, zone_name, date_order, {v} AS v FROM orchestrator_hotel_sample s
                   LEFT JOIN (SELECT source, min(zone_name) AS zone_name, min(date_order) AS date_order FROM source_profiles WHERE source IS NOT NULL GROUP BY 1) p ON s.source = p.source),
        k AS (SELECT *, {form} AS form FROM b), f AS (SELECT *, {parts} FROM k),
        n AS (SELECT *, CASE WHEN {swap} THEN try_cast(d AS INTEGER) ELSE {month} END AS month_, CASE WHEN {swap} THEN try_cast(mo AS INTEGER) ELSE try_cast(d AS INTEGER) END AS day_,
                     CASE WHEN half = '' THEN {number('h')} WHEN try_cast(h AS INTEGER) BETWEEN 1 AND 12 THEN try_cast(h AS INTEGER) % 12 + CASE WHEN lower(half) = 'p' THEN 12 ELSE 0 END END AS hour_, {number('mi')} AS min_, {number('se')} AS sec_,
                     CASE WHEN z = '' THEN zone_name ELSE z END AS zone FROM f),
        t AS (SELECT *, try_cast(printf('%s-%02d-%02d', y, month_, day_) AS DATE) AS date_ FROM n),
        l AS (SELECT *, CASE WHEN (wd = '' OR lower(wd) = lower(dayname(date_)[1:3])) AND hour_ BETWEEN 0 AND 23 AND min_ BETWEEN 0 AND 59 AND sec_ BETWEEN 0 AND 59
                     THEN epoch_us(CAST(date_ AS TIMESTAMP)) + (hour_ * 3600 + min_ * 60 + sec_) * 1000000::BIGINT + CAST(rpad(fr, 9, '0')[1:6] AS BIGINT) END AS local_,
                     CASE WHEN regexp_matches(zone, '^[+-]\\d{{2}}(:?\\d{{2}})?$') AND CAST(zone[2:3] AS INTEGER) <= 18 AND coalesce(try_cast(replace(zone, ':', '')[4:5] AS INTEGER), 0) < 60
                          THEN CASE WHEN zone[1] = '-' THEN -1 ELSE 1 END * (CAST(zone[2:3] AS BIGINT) * 60 + coalesce(try_cast(replace(zone, ':', '')[4:5] AS BIGINT), 0)) * 60000000 WHEN lower(zone) IN ('z', 'utc', 'gmt') THEN 0 END AS fixed,
                     CASE WHEN regexp_matches(v, '{EPOCH}') THEN CAST(v AS BIGINT) * CASE WHEN length(replace(v, '-', '')) >= 15 THEN 1 WHEN length(replace(v, '-', '')) >= 12 THEN 1000 ELSE 1000000 END END AS epoch_ FROM t),
        m AS (SELECT l.*, tz.name AS named FROM l LEFT JOIN (SELECT DISTINCT name FROM pg_timezone_names()) tz ON l.fixed IS NULL AND l.zone = tz.name),
        o AS (SELECT *, local_ - {offset('local_ - 93600000000')} AS one_, local_ - {offset('local_ + 93600000000')} AS two_ FROM m),
        c AS (SELECT *, CASE WHEN {offset('one_')} = local_ - one_ THEN one_ END AS one, CASE WHEN {offset('two_')} = local_ - two_ THEN two_ END AS two FROM o),
        r AS (SELECT *, CASE WHEN coalesce(v, '') = '' THEN 'missing' WHEN epoch_ IS NOT NULL THEN 'ok'
                WHEN form IS NULL THEN CASE WHEN regexp_matches(v, {quoted(RELATIVE)}) THEN 'relative' WHEN regexp_matches(v, {quoted(PARTIAL)}) THEN 'partial' ELSE 'unknown_format' END
                WHEN form = 'slashed' AND date_order IS NULL THEN 'no_order' WHEN local_ IS NULL THEN 'impossible' WHEN zone IS NULL THEN 'no_zone' WHEN fixed IS NOT NULL THEN 'ok' WHEN named IS NULL THEN 'impossible'
                WHEN one IS NOT NULL AND two IS NOT NULL AND one <> two THEN 'ambiguous' WHEN one IS NULL AND two IS NULL THEN 'nonexistent' ELSE 'ok' END AS review_ts_utc_status FROM c),
        u AS (SELECT *, CASE WHEN review_ts_utc_status = 'ok' THEN strftime(make_timestamp(coalesce(epoch_, local_ - fixed, one, two)), '%Y-%m-%dT%H:%M:%S.%fZ') END AS review_ts_utc FROM r)
        SELECT {columns} FROM u WHERE {where}"""


QUERIES = {"p4_found": p4_found, "p4_normalised": p4_normalised}
SQL: dict[str, str] = {"p4_found": _sql("row_ord, review_ts_utc", "review_ts_utc IS NOT NULL"), "p4_normalised": _sql("row_ord, review_date, source, review_ts_utc, review_ts_utc_status", "true")}
