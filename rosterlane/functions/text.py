"""Standardisation of names, addresses, phones and specialties as column expressions.

White space here is what a browser's regular expressions call white space, which is more than Java's \\s; the end of a text is
its absolute end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\u00a0\ufeff\u2000-\u200a\u3000]"

#: The codes of the 50 states.
STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY"
).split()


def trim(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{WS}+", ""), f"{WS}+\\z", "")


def blank_to_null(c: Column) -> Column:
    """Null, the empty text and white space alone are all missing."""
    return F.when(trim(c) != "", c)


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, f"{WS}+", " "))


def normalize_text(c: Column) -> Column:
    return F.coalesce(collapse(F.lower(c)), F.lit(""))


def normalize_address(c: Column) -> Column:
    return F.coalesce(collapse(F.regexp_replace(F.lower(c), r"[.,\-]", " ")), F.lit(""))


def phone_with_plus(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9+]", "")


def phone_digits(c: Column) -> Column:
    """Digits only; null equals the empty text."""
    return F.coalesce(F.regexp_replace(c, "[^0-9]", ""), F.lit(""))


def format_phone(c: Column, country: bool = False) -> Column:
    """ddd-ddd-dddd for 10 digits (or, with country, 11 that start with 1); else unchanged."""
    d = phone_digits(c)
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d) if country else d
    return F.when(F.length(d) == 10, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4))).otherwise(c)


def normalize_specialty(c: Column) -> Column:
    """Lower case, words sorted: the order of words doesn't matter."""
    words = F.split(F.regexp_replace(F.lower(c), r"[,.\-]", " "), f"{WS}+")
    return F.coalesce(F.array_join(F.array_sort(F.filter(words, lambda w: w != "")), " "), F.lit(""))


def name_for_search(c: Column) -> Column:
    return F.coalesce(collapse(F.regexp_replace(c, r"[(),]", " ")), F.lit(""))


def name_without_credentials(c: Column) -> Column:
    return F.coalesce(trim(F.substring_index(c, "(", 1)), F.lit(""))


def credentials(c: Column) -> Column:
    """What the first parentheses hold, in parts."""
    inside = F.regexp_extract(c, r"\(([^)]+)\)", 1)
    return F.coalesce(F.filter(F.transform(F.split(inside, ","), trim), lambda x: x != ""), F.array().cast("array<string>"))


def name_for_registry(c: Column) -> Column:
    plain = F.regexp_replace(c, rf"{WS}*\([^)]+\)", "")
    for tail in (rf"{WS}*,{WS}*[A-Za-z]+{WS}*\z", rf"{WS}*,{WS}+[A-Za-z]+\z"):
        plain = F.regexp_replace(plain, tail, "")
    return F.coalesce(F.regexp_replace(F.upper(collapse(plain)), r"[.\-']", ""), F.lit(""))


def last_name(c: Column) -> Column:
    """Text before a comma, else the last word, without titles and credentials."""
    plain = trim(F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", ""), r"(?i)(?<!\w)(dr|mr|mrs|ms|md|do|dds|phd|rn|np|pa)\.?(?!\w)", ""))
    return F.when(plain.contains(","), trim(F.substring_index(plain, ",", 1))).otherwise(F.element_at(F.split(plain, f"{WS}+"), -1))


def _none(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def extract_zip(c: Column) -> Column:
    return _none(F.regexp_extract(c, r"(?<!\w)(\d{5})(?:-\d{4})?(?!\w)", 1))


def extract_state(c: Column) -> Column:
    return _none(F.regexp_extract(c, rf"(?<!\w)([A-Z]{{2}}){WS}+\d{{5}}", 1))


def extract_city(c: Column) -> Column:
    """The third part from the right, if there are three (so "street, city, ST zip" gives the street)."""
    parts = F.split(c, ",")
    return F.when(F.size(parts) >= 3, _none(trim(F.element_at(parts, -3))))


def normalize_field_name(c: Column) -> Column:
    return F.regexp_replace(trim(F.lower(c)), f"{WS}+", "_")


def truthy(c: Column) -> Column:
    """A text as a boolean column's value."""
    return F.when(c.isNotNull(), F.lower(trim(c)).isin("true", "yes", "1"))
