"""Column functions on review text, ratings and labels. All stay inside Spark's code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted spellings of the domains, after lower case and with an underscore for a hyphen.
DOMAIN_ALIASES = {
    "mobile app": "mobile_app", "mobile_app": "mobile_app", "app": "mobile_app", "google_play": "mobile_app", "e-commerce": "ecommerce", "e_commerce": "ecommerce", "ecommerce": "ecommerce",
    "amazon": "ecommerce", "hotel": "hotel", "hotels": "hotel", "restaurant": "restaurant", "restaurants": "restaurant", "yelp": "restaurant",
}
#: Spellings that an upload in the common schema may have.
UPLOAD_ALIASES = {"app": "mobile_app", "mobile": "mobile_app", "mobile app": "mobile_app", "e-commerce": "ecommerce", "e_commerce": "ecommerce", "product": "ecommerce"}
#: What stands for an empty side of a hotel review, exactly as written.
PLACEHOLDERS = ("No Negative", "No Positive", "nan", "None")
#: Sides of a hotel review, cleaned, that say nothing.
NEGATIVE_PLACEHOLDERS = (
    "no negative", "none", "nothing", "nothing really", "nothing at all", "n/a", "na", "nil", "no complaints", "no complaint", "no issues",
    "nothing to dislike", "nothing negative", "all good", "everything was perfect",
)
POSITIVE_PLACEHOLDERS = ("no positive", "none", "nothing", "nothing really", "nothing at all", "n/a", "na", "nil", "nothing positive", "nothing special")
#: Words that turn a sentence round.
CONTRASTS = "but|however|although|though|yet|except|while|whereas"
DOMAINS = ("mobile_app", "hotel", "ecommerce", "restaurant")
LABELS = ("negative", "neutral", "positive")
URL = r"(https?://[^ \t\r\n]+)|(www\.[^ \t\r\n]+)"


def squeeze(c: Column) -> Column:
    """Line breaks and runs of white space become one space; ends are trimmed; null is empty."""
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\p{Z}]+", " "))


def trimmed(c: Column) -> Column:
    """White space of any kind at the ends removed; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def without_urls(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), URL, " "))


def without_markup(c: Column) -> Column:
    """Tags and links removed."""
    return without_urls(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " "))


def clean_text(c: Column) -> Column:
    """Lower case, without links, punctuation and digits."""
    x = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), URL, " ")
    return squeeze(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}_\s]", " "), r"[\p{Nd}_]+", " "))


def normal_text(c: Column, digits: bool = True) -> Column:
    """The form that tells texts apart: lower case, without links and punctuation, digits kept on request."""
    if not digits:
        return clean_text(without_markup(c))
    x = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), URL, " ")
    return squeeze(F.regexp_replace(x, r"[^\p{L}\p{N}_\s]", " "))


def text_key(c: Column) -> Column:
    return F.md5(normal_text(c, digits=False))


def text_hash(c: Column) -> Column:
    return F.sha2(normal_text(c), 256)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(squeeze(c), " "), lambda w: w != ""))


def has_phrase(cleaned: Column, phrase: Column) -> Column:
    """Whether a cleaned text holds the phrase as whole words."""
    return F.contains(F.concat(F.lit(" "), cleaned, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def placeholder_to_empty(c: Column) -> Column:
    """Exactly the placeholders are empty; a side that says nothing in other words stays."""
    x = squeeze(c)
    return F.when(x.isin(*PLACEHOLDERS), "").otherwise(x)


def says_something(c: Column, placeholders: tuple[str, ...]) -> Column:
    """Whether a side is more than a placeholder, judged by its cleaned form."""
    x = normal_text(c, digits=False)
    return (x != "") & ~x.isin(*placeholders)


def number(c: Column) -> Column:
    """A double, or null if the text is not a number."""
    return F.btrim(c.cast("string")).try_cast("double")


def safe_rating(c: Column) -> Column:
    """Null and non-numbers are 3; above 5 is out of ten; the result lies in 1..5."""
    x = F.coalesce(number(c), F.lit(3.0))
    x = F.when(F.isnan(x), 3.0).otherwise(x)
    return F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.when(x > 5, x / 2).otherwise(x)))


def clipped_rating(c: Column) -> Column:
    """Clipped to 1..5, null if not a number."""
    return F.when(number(c).isNotNull(), F.least(F.lit(5.0), F.greatest(F.lit(1.0), number(c))))


def rating_label(rating: Column) -> Column:
    return F.when(rating.isNull(), "neutral").when(rating <= 2, "negative").when(rating < 4, "neutral").otherwise("positive")


def strict_rating_label(rating: Column) -> Column:
    """Only whole steps count: between 2 and 3 and between 3 and 4 there is no label."""
    return F.when(rating <= 2, "negative").when(rating == 3, "neutral").when(rating >= 4, "positive")


def known_label(c: Column) -> Column:
    """negative, neutral or positive for the usual spellings, else null."""
    x = F.lower(squeeze(c))
    return F.when(x.isin("neg", "negative"), "negative").when(x.isin("pos", "positive"), "positive").when(x.isin("neu", "neutral"), "neutral")


def _alias(c: Column, aliases: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), c)


def normal_domain(c: Column) -> Column:
    """Lower case, underscores for hyphens, aliases; any other value with underscores for spaces."""
    x = F.replace(F.lower(squeeze(c)), F.lit("-"), F.lit("_"))
    return F.coalesce(_alias(x, DOMAIN_ALIASES), F.replace(x, F.lit(" "), F.lit("_")))


def known_domain(c: Column) -> Column:
    """normal_domain() if it is one of the four, else null."""
    x = normal_domain(c)
    return F.when(x.isin(*DOMAINS), x)


def upload_domain(c: Column) -> Column:
    """The domain of an upload in the common schema, or null if it is none of the four."""
    x = F.lower(F.btrim(F.coalesce(c, F.lit(""))))
    x = F.coalesce(_alias(x, UPLOAD_ALIASES), x)
    return F.when(x.isin(*DOMAINS), x)


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")


def title_label(c: Column) -> Column:
    return F.initcap(F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" ")))


def review_id(*parts: Column) -> Column:
    return F.md5(F.concat_ws("_", *parts))


def sentences(c: Column) -> Column:
    """Array of a text's sentences: cut after a full stop, exclamation or question mark before white space, and at line breaks."""
    lines = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\n\r]+", "\n"), r"([.!?])[\s\p{Z}]+", "$1\n")
    return F.filter(F.transform(F.split(lines, "\n"), squeeze), lambda x: x != "")


_CONTRAST = rf"(?i)([^\p{{L}}\p{{N}}_]|^)(?:{CONTRASTS})([^\p{{L}}\p{{N}}_]|$)"


def clauses(sentence: Column) -> Column:
    """Array of a sentence's parts between words that turn it round, commas, semicolons and colons."""
    marked = F.regexp_replace(sentence, "[,;:]", "\n")
    # twice, as two such words may share the space between them
    marked = F.regexp_replace(F.regexp_replace(marked, _CONTRAST, "$1\n$2"), _CONTRAST, "$1\n$2")
    return F.split(marked, "\n")


def segments(c: Column, most: int = 8) -> Column:
    """The whole text, then its sentences and their clauses: without marks at the ends, of two words at least, each once whatever its case, `most` at most."""
    whole = F.btrim(squeeze(c), F.lit(" -–—,;:"))
    parts = F.flatten(F.transform(sentences(c), lambda s: F.concat(F.array(s), clauses(s))))
    trimmed = F.filter(F.transform(parts, lambda p: F.btrim(squeeze(p), F.lit(" -–—,;:"))), lambda p: F.contains(p, F.lit(" ")))
    every = F.concat(F.array(whole), trimmed)
    return F.slice(F.filter(every, lambda p, i: F.array_position(F.transform(every, lambda q: F.lower(q)), F.lower(p)) == i + 1), 1, most)


def evidence_window(c: Column, phrases: Column, most: int = 180) -> Column:
    """The text round the first of the phrases, 70 characters before and 90 after; else its first sentence. `most` characters at most.

    phrases: those that the text holds, the longest first.
    """
    x = squeeze(c)
    word = F.coalesce(F.try_element_at(phrases, F.lit(1)), F.lit(""))
    bare = F.concat(F.lit(" "), F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_]", " "), F.lit(" "))
    at = F.when(word == "", 0).otherwise(F.instr(bare, F.concat(F.lit(" "), word, F.lit(" "))))
    first = F.greatest(at - 70, F.lit(1))
    last = F.least(at - 1 + F.length(word) + 90, F.length(x))
    window = F.btrim(F.substring(x, first, last - first + 1))
    return F.substring(F.when(at > 0, window).otherwise(F.coalesce(F.try_element_at(sentences(x), F.lit(1)), F.lit(""))), 1, most)


def name_match(a: Column, b: Column) -> Column:
    """How alike two names are: 1 if equal, by length but 0.82 at least if one holds the other, else F1 of their words."""
    plain = lambda c: squeeze(F.regexp_replace(F.lower(squeeze(c)), r"[^\p{L}\p{N}_\s]", " "))
    x, y = plain(a), plain(b)
    words = lambda c: F.array_distinct(F.split(c, " "))
    common = F.size(F.array_intersect(words(x), words(y)))
    f1 = 2.0 * common / (F.size(words(x)) + F.size(words(y)))
    length = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))
    return F.round(F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), F.greatest(F.lit(0.82), length)).otherwise(f1), 4)


def star_label(star: Column) -> Column:
    return F.when(star <= 2, "negative").when(star == 3, "neutral").otherwise("positive")


def label_star(label: Column) -> Column:
    """The star that a label stands for."""
    return F.when(label == "negative", 1).when(label == "neutral", 3).otherwise(5)


def total(weights: Column) -> Column:
    return F.aggregate(F.transform(weights, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)


def expected_star(weights: Column) -> Column:
    """The mean place in an array of weights, counted from 1."""
    return total(F.transform(weights, lambda x, i: x * (i + 1))) / total(weights)


def as_percent(c: Column) -> Column:
    """A share of up to 1.5 is taken for a fraction."""
    return F.when(F.abs(c) <= 1.5, c * 100).otherwise(c)


def parsed_json(c: Column, schema: str) -> Column:
    """The first object in a text, without code fences, by the schema; null fields if it cannot be read."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"```(?:json)?", "")
    return F.from_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0), schema)
