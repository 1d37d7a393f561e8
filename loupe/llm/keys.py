"""Column forms of entity keys, domains and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOMAINS = ("ecommerce", "hotel", "mobile_app", "restaurant")
LABELS = ("positive", "negative", "neutral")
#: The short and plural forms of the domains and labels, after dropping case, space, hyphen, underscore and final dot.
_FORMS = {
    "ecommerce": ("ecommerce", "ecommerces", "eco", "ecom"),
    "hotel": ("hotel", "hotels", "hot"),
    "mobile_app": ("mobileapp", "mobileapps", "mob"),
    "restaurant": ("restaurant", "restaurants", "res"),
    "positive": ("positive", "positives", "pos"),
    "negative": ("negative", "negatives", "neg"),
    "neutral": ("neutral", "neutrals", "neu"),
}


def entity_key(c: Column) -> Column:
    """Lower case; every run of characters other than letters and digits is one space. Null for null or blank."""
    key = F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(key) > 0, key)


def _plain_value(c: Column, values: tuple[str, ...]) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"[\s\p{Z}_\-]+", ""), r"\.+$", "")
    forms = F.create_map(*[F.lit(x) for v in values for f in _FORMS[v] for x in (f, v)])
    return F.try_element_at(forms, bare)


def domain(c: Column) -> Column:
    """One of the four domains, or null."""
    return _plain_value(c, DOMAINS)


def label(c: Column) -> Column:
    """One of the three labels, or null."""
    return _plain_value(c, LABELS)
