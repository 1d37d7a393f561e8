"""Reading review files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loupe.functions.text import squeeze
from loupe.operators.standardise import conform

#: Texts that stand for a missing value.
MISSING = ("", "#N/A", "N/A", "NA", "NaN", "None", "n/a", "nan", "null", "NULL", "<NA>")


def missing_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Placeholders of missing values become null, before any rule sees them."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    return df.withColumns({n: F.when(~F.btrim(F.col(f"`{n}`")).isin(*MISSING), F.col(f"`{n}`")) for n in names})


def _valid_utf8(batches):  # noqa: ANN001, ANN202
    """(path, utf8) of files (path, content): whether the bytes decode strictly."""
    import pandas as pd

    def decodes(content: bytes) -> bool:
        try:
            content.decode("utf-8")
        except UnicodeDecodeError:
            return False
        return True

    for b in batches:
        yield pd.DataFrame({"path": b["path"], "utf8": [decodes(c) for c in b["content"]]})


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, encodings: tuple[str, str] = ("UTF-8", "ISO-8859-1"), multi_line: bool = True) -> DataFrame:
    """CSV in the first encoding, or in the second where a file's bytes are not well-formed UTF-8.

    Files are judged one by one by their bytes, in tasks, so a true replacement character is no sign of damage; files of both kinds may lie in
    one folder. multi_line: quoted line breaks are read, for which a file is one task; without them files are split. A byte order mark is
    dropped from the first column's name.
    """
    def load(paths: list[str] | str, encoding: str) -> DataFrame:
        reader = spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"').option("encoding", encoding)
        return (reader.schema(schema) if schema is not None else reader).csv(paths)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    # names of the files in another encoding, which are few or all of one kind
    other = [r["path"] for r in files.mapInPandas(_valid_utf8, "path string, utf8 boolean").where("NOT utf8").select("path").toLocalIterator()]
    if not other:
        df = load(path, encodings[0])
    else:
        df = load(other, encodings[1])
        rest = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").toLocalIterator() if r["path"] not in set(other)]
        if rest:
            df = df.unionByName(load(rest, encodings[0]))
    first = df.columns[0]
    return df.withColumnRenamed(first, first.lstrip(chr(0xFEFF))) if first.startswith(chr(0xFEFF)) else df


def read_common(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of the common schema, typed; missing columns are null."""
    return conform(missing_to_null(read_csv(spark, path)))


def single_review(spark: SparkSession, text: str, rating: float, domain: str, entity: str = "single_review") -> DataFrame:
    """One literal row of the common schema."""
    if not text or not text.strip():
        raise ValueError("the review is empty")
    row = [("single_1", domain, entity, entity, text.strip(), float(rating), str(rating), None, "single_review", None)]
    return spark.createDataFrame(row, "review_id string, domain string, entity_id string, entity_name string, review_text string, rating double, rating_original string, review_date string, source string, raw_source_path string")


def input_kind(c: Column) -> Column:
    """csv, play_url, maps_url, app_id or text, of what a user typed."""
    x = F.btrim(F.coalesce(c, F.lit("")))
    return (
        F.when(F.lower(x).endswith(".csv"), "csv")
        .when(x.rlike(r"^https?://play\.google\.com/store/apps/details\?"), "play_url")
        .when(maps_url_allowed(x), "maps_url")
        .when(x.rlike(r"^[A-Za-z][A-Za-z0-9_]*(\.[A-Za-z][A-Za-z0-9_]*){1,}$"), "app_id")
        .otherwise("text")
    )


def maps_url_allowed(c: Column) -> Column:
    """http(s), no credentials, standard port, a maps host with /maps in its path, or one of its short hosts."""
    x = F.btrim(F.coalesce(c, F.lit("")))
    start, port = r"^https?://", r"\.?(:(80|443))?"
    long_host = start + r"(www\.|maps\.)?google(\.[a-z]{2,3}){1,2}" + port + r"(/[^?#@]*)?/maps"
    return x.rlike("(?i)" + long_host) | x.rlike("(?i)" + start + r"maps\.app\.goo\.gl" + port + r"([/?#]|$)") | x.rlike("(?i)" + start + r"goo\.gl" + port + r"/maps")


def place_id(url: Column) -> Column:
    """A place's identity from its address: the pair of hexadecimal numbers, cid, ftid, the path's name, or the beginning of a hash."""
    x = F.coalesce(url, F.lit(""))
    patterns = (r"!1s(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)", r"[?&]cid=(\d+)", r"[?&]ftid=([^&]+)", r"/place/([^/]+)")
    found = [F.regexp_extract(x, p, 1) for p in patterns]
    chosen = F.coalesce(*[F.when(f != "", F.substring(f, 1, 160)) for f in found])
    return F.coalesce(chosen, F.concat(F.lit("place_"), F.substring(F.sha2(x, 256), 1, 24)))


def place_name(url: Column) -> Column:
    """The readable name in a place's address, or nothing."""
    name = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)/maps/place/([^/@?#]+)", 1)
    return squeeze(F.replace(F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name), F.lit("+"), F.lit(" ")))


def place_coordinates(url: Column) -> tuple[Column, Column]:
    """Latitude and longitude in a place's address as they are written, or nothing."""
    x, n = F.coalesce(url, F.lit("")), r"(-?\d+(?:\.\d+)?)"
    pair = [F.when(F.regexp_extract(x, p, i) != "", F.regexp_extract(x, p, i)) for i in (1, 2) for p in (f"@{n},{n}", f"!3d{n}!4d{n}")]
    return F.coalesce(pair[0], pair[1], F.lit("")), F.coalesce(pair[2], pair[3], F.lit(""))


def label_rating(c: Column) -> Column:
    """1 to 5 from a label such as `4,5 stars`, or null."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)([1-5](?:[.,]\d+)?)\s*(?:stars?)?", 1)
    number = F.replace(found, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(number.isNotNull(), F.least(F.lit(5.0), F.greatest(F.lit(1.0), number)))


def label_count(c: Column) -> Column:
    """The number of reviews from a label such as `1,234 reviews`, or null."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)([\d,.\s]+)\s+reviews?", 1), r"\D", "").try_cast("long")


def app_id(c: Column) -> Column:
    """The app's package name, from itself or from a store link; null if there is none."""
    x = F.btrim(F.coalesce(c, F.lit("")))
    linked = F.regexp_extract(x, r"[?&]id=([A-Za-z0-9_.]+)", 1)
    return F.when(linked != "", linked).when(x.rlike(r"^[A-Za-z][A-Za-z0-9_]*(\.[A-Za-z][A-Za-z0-9_]*)+$"), x)
