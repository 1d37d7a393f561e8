"""Mixed timestamp formats and time zones: one instant in UTC for every value that names exactly one.

An ordered cascade of anchored patterns takes a value apart; the first that fits the whole value counts. Parsing is strict:
an impossible day, hour, weekday or zone gives no instant. A value without a zone is in the default zone of its source, which
a lookup table names together with the order of slashed dates. Local times that come twice or are skipped follow a policy.
Everything is built from Spark's own expressions; no result depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DAY = 86_400_000_000
_HOUR = 3_600_000_000
#: English month and weekday names.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_HALF = r"(?:\s?([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s?(Z|z|[+-]\d{2}(?::?\d{2})?|[A-Za-z][A-Za-z_]*(?:/[A-Za-z0-9_+-]+)*))?"
#: (name, pattern, the parts year, month, day, hour, minute, second, fraction, half of the day, zone, weekday by group number)
CASCADE: list[tuple[str, str, tuple[int, ...]]] = [
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt ]{_CLOCK}{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 0)),
    ("basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})?{_ZONE}$", (1, 2, 3, 4, 5, 6, 0, 0, 7, 0)),
    ("year first", rf"^(\d{{4}})/(\d{{2}})/(\d{{2}})(?:,? {_CLOCK}{_HALF}{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 8, 9, 0)),
    ("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?: {_CLOCK}{_HALF}{_ZONE})?$", (3, 2, 1, 4, 5, 6, 7, 8, 9, 0)),
    ("slashed", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,? {_CLOCK}{_HALF}{_ZONE})?$", (3, 1, 2, 4, 5, 6, 7, 8, 9, 0)),
    ("mail", rf"^(?:([A-Za-z]{{3}}), )?(\d{{1,2}}) ([A-Za-z]{{3,9}})\.? (\d{{4}})(?: {_CLOCK}{_HALF}{_ZONE})?$", (4, 3, 2, 5, 6, 7, 8, 9, 10, 1)),
    ("prose", rf"^([A-Za-z]{{3,9}})\.? (\d{{1,2}}), (\d{{4}})(?:,? {_CLOCK}{_HALF}{_ZONE})?$", (3, 1, 2, 4, 5, 6, 7, 8, 9, 0)),
]
#: Seconds, milliseconds or microseconds, by the number of digits; before 1970 with a minus.
EPOCH = r"^-?\d{9,11}$|^-?\d{12,13}$|^-?\d{15,16}$"
RELATIVE = r"(?i)^(edited\s+)?((an?|\d+)\s+\w+\s+ago|today|yesterday|just now|last \w+)$"
PARTIAL = r"(?i)^([a-z]{3,9}\.? \d{4}|\d{4}|\d{4}-\d{2}|\d{1,2}:\d{2}(:\d{2})?|\d{1,2} [a-z]{3,9})$"
_PARTS = ("year", "month", "day", "hour", "minute", "second", "fraction", "half", "zone", "weekday")


def known_zones(spark: SparkSession) -> DataFrame:
    """The zone names that the JVM knows: about 600, whatever the data, so the lookup may be broadcast."""
    names = sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())
    return F.broadcast(spark.createDataFrame([(n,) for n in names], "__named string"))


def _bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with these columns, each computed once a row: the optimizer merges no expression and moves no filter through it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _digits(c: Column) -> Column:
    return F.length(F.replace(c, F.lit("-"), F.lit("")))


def _number(c: Column) -> Column:
    return F.when(c == "", F.lit(0)).otherwise(c.try_cast("int"))


def _offset(at: Column, zone: Column) -> Column:
    """Microseconds that local time is ahead of UTC in the zone at this instant."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(at), zone)) - at


def iso_utc(micros: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.ffffffZ of microseconds since 1970."""
    day = F.floor(micros / F.lit(_DAY)).cast("int")
    rest = F.pmod(micros, F.lit(_DAY))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    whole = lambda unit: F.floor(rest / F.lit(unit)).cast("long")
    clock = F.concat_ws(":", pad(whole(_HOUR), 2), pad(whole(60_000_000) % 60, 2), pad(whole(1_000_000) % 60, 2))
    return F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), clock, F.lit("."), pad(rest % 1_000_000, 6), F.lit("Z"))


def normalise_timestamps(
    df: DataFrame,
    profiles: DataFrame,
    value: str = "review_date",
    source: str = "source",
    out: str = "review_ts_utc",
    ambiguous: str = "reject",
    nonexistent: str = "reject",
) -> DataFrame:
    """df with `out` (string, null if no instant) and `out`_status; columns of those names are replaced.

    profiles has source, zone_name and date_order, a row per source. It is read as a lookup of a few rows; Spark broadcasts it
    only below its own size threshold. Of repeated sources the smallest zone and order count, so no row of df is doubled.

    Status: ok, missing (null or blank), relative, partial, impossible (fits a pattern but not the calendar, clock or zone
    list), unknown_format, no_order (slashed, source without order), no_zone (no zone in value or source), ambiguous, nonexistent.
    Digits of a second beyond microseconds are cut.
    ambiguous: reject, earlier or later of both instants. nonexistent: reject, or forward (the offset before the gap holds).
    Null values or sources never fail; ties and repeated rows each keep their own row; an empty table stays empty.
    """
    if ambiguous not in ("reject", "earlier", "later") or nonexistent not in ("reject", "forward"):
        raise ValueError("unknown policy")
    spark = df.sparkSession
    zones = known_zones(spark)
    kept = [c for c in df.columns if c not in (out, f"{out}_status")]
    look = (
        profiles.where(F.col("source").isNotNull())
        .groupBy(F.col("source").alias("__source"))
        .agg(F.min("zone_name").alias("__default_zone"), F.min("date_order").alias("__order"))
    )
    v = F.btrim(F.regexp_replace(F.col(value).cast("string"), r"[\s\p{Z}]+", " "))
    x = df.select(*[F.col(f"`{c}`") for c in kept], v.alias("__v"), F.col(source).alias("__s"))
    x = x.join(look, x["__s"] == look["__source"], "left")

    parts = F.lit(None).cast("array<string>")
    for name, pattern, groups in reversed(CASCADE):
        taken = F.concat(F.lit(name + "~"), F.regexp_replace("__v", pattern, "~".join(f"${g}" if g else "" for g in groups)))
        parts = F.when(F.col("__v").rlike(pattern), F.split(taken, "~")).otherwise(parts)
    x = _bind(x, {"__p": parts})
    part = {n: F.col("__p")[i + 1] for i, n in enumerate(_PARTS)}
    slashed = F.col("__p")[0] == "slashed"
    swap = slashed & (F.col("__order") == "dmy")
    names = F.array(*[F.lit(m) for m in MONTHS])
    short = F.array(*[F.lit(m[:3]) for m in MONTHS])
    written = F.lower(part["month"])
    by_name = F.greatest(F.array_position(names, written), F.array_position(short, written)).cast("int")
    month = F.when(part["month"].rlike(r"^\d"), F.when(swap, _number(part["day"])).otherwise(_number(part["month"]))).otherwise(by_name)
    day = F.when(swap, _number(part["month"])).otherwise(_number(part["day"]))
    hour = _number(part["hour"])
    hour = F.when(part["half"] == "", hour).when(hour.between(1, 12), hour % 12 + F.when(F.lower(part["half"]) == "p", 12).otherwise(0))
    x = _bind(
        x,
        {
            "__date": F.try_to_date(F.format_string("%s-%02d-%02d", part["year"], month, day), "yyyy-MM-dd"),
            "__clock": F.when(
                hour.between(0, 23) & _number(part["minute"]).between(0, 59) & _number(part["second"]).between(0, 59),
                (hour * 3600 + _number(part["minute"]) * 60 + _number(part["second"])).cast("long") * 1_000_000
                + F.substring(F.rpad(part["fraction"], 9, "0"), 1, 6).cast("long"),
            ),
            "__zone": F.when(part["zone"] == "", F.col("__default_zone")).otherwise(part["zone"]),
            "__epoch": F.when(
                F.col("__v").rlike(EPOCH),
                F.col("__v").try_cast("long") * F.when(_digits(F.col("__v")) >= 15, 1).when(_digits(F.col("__v")) >= 12, 1_000).otherwise(1_000_000),
            ),
        },
    )
    weekday_fits = (part["weekday"] == "") | (F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.lower(part["weekday"])) == F.weekday("__date") + 1)
    offset_form = F.col("__zone").rlike(r"^[+-]\d{2}(:?\d{2})?$")
    digits = F.regexp_replace("__zone", ":", "")
    hours, minutes = F.substring(digits, 2, 2).try_cast("long"), F.when(F.length(digits) == 3, F.lit(0).cast("long")).otherwise(F.substring(digits, 4, 2).try_cast("long"))
    fixed = F.when(
        offset_form & (hours <= 18) & (minutes < 60),
        F.when(F.startswith(digits, F.lit("-")), F.lit(-1)).otherwise(F.lit(1)) * (hours * 60 + minutes) * 60_000_000,
    ).when(F.lower("__zone").isin("z", "utc", "gmt"), F.lit(0).cast("long"))
    x = _bind(x, {"__local": F.when(weekday_fits, F.unix_date("__date").cast("long") * _DAY + F.col("__clock")), "__fixed": fixed})
    x = x.join(zones, F.when(F.col("__fixed").isNull(), F.col("__zone")) == F.col("__named"), "left")
    x = _bind(x, {"__before": _offset(F.col("__local") - 26 * _HOUR, F.col("__named")), "__after": _offset(F.col("__local") + 26 * _HOUR, F.col("__named"))})
    one, two = F.col("__local") - F.col("__before"), F.col("__local") - F.col("__after")
    x = _bind(x, {"__one": F.when(_offset(one, F.col("__named")) == F.col("__before"), one), "__two": F.when(_offset(two, F.col("__named")) == F.col("__after"), two)})
    twice = F.col("__one").isNotNull() & F.col("__two").isNotNull() & (F.col("__one") != F.col("__two"))
    never = F.col("__one").isNull() & F.col("__two").isNull()
    status = (
        F.when(F.coalesce(F.col("__v"), F.lit("")) == "", "missing")
        .when(F.col("__epoch").isNotNull(), "ok")
        .when(F.col("__p").isNull(), F.when(F.col("__v").rlike(RELATIVE), "relative").when(F.col("__v").rlike(PARTIAL), "partial").otherwise("unknown_format"))
        .when(slashed & F.col("__order").isNull(), "no_order")
        .when(F.col("__local").isNull(), "impossible")
        .when(F.col("__zone").isNull(), "no_zone")
        .when(F.col("__fixed").isNotNull(), "ok")
        .when(F.col("__named").isNull(), "impossible")
        .when(twice, "ok" if ambiguous != "reject" else "ambiguous")
        .when(never, "ok" if nonexistent != "reject" else "nonexistent")
        .otherwise("ok")
    )
    pick = {"reject": F.coalesce("__one", "__two"), "earlier": F.least("__one", "__two"), "later": F.greatest("__one", "__two")}[ambiguous]
    instant = F.coalesce(F.col("__epoch"), F.col("__local") - F.col("__fixed"), pick, one)
    x = _bind(x, {"__status": status, "__instant": instant})
    x = _bind(x, {out: F.when(F.col("__status") == "ok", iso_utc(F.col("__instant"))), f"{out}_status": F.col("__status")})
    return x.select(*[F.col(f"`{c}`") for c in kept], out, f"{out}_status")
