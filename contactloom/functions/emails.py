"""Address predicates, extraction and list formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import EMAIL_BASIC, EMAIL_PREFIX, EMAIL_STRICT, EMAIL_TOKEN, EMAIL_TOKEN_FOLDED
from .text import storage_key, strip


def is_email_prefix(c: Column) -> Column:
    """Starts like an address; anything may follow."""
    return F.coalesce(c.rlike(EMAIL_PREFIX), F.lit(False))


def is_email_basic(c: Column) -> Column:
    """The trimmed value is address-shaped as a whole."""
    return F.coalesce(strip(c).rlike(EMAIL_BASIC), F.lit(False))


def is_email_strict(c: Column) -> Column:
    """Basic plus the length, dot and domain rules."""
    return F.coalesce(storage_key(c).rlike(EMAIL_STRICT), F.lit(False))


def email_domain(c: Column) -> Column:
    """Lower-case domain of a strictly valid address, else NULL."""
    return F.when(is_email_strict(c), F.lower(F.split_part(c, F.lit("@"), F.lit(2))))


def extract_emails(text: Column) -> Column:
    """Distinct strictly valid addresses in free text, lower case.

    Texts without an @ never reach the regex.
    """
    tokens = F.regexp_extract_all(text, F.lit(EMAIL_TOKEN_FOLDED), F.lit(1))
    valid = F.filter(F.transform(tokens, F.lower), is_email_strict)
    return F.when(F.contains(text, F.lit("@")), F.array_distinct(valid)).otherwise(_none())


def basic_tokens(text: Column) -> Column:
    """Address tokens of a text that pass the basic test, lower case, repeats kept."""
    tokens = F.regexp_extract_all(text, F.lit(EMAIL_TOKEN), F.lit(1))
    return F.when(F.contains(text, F.lit("@")), F.transform(tokens, F.lower)).otherwise(_none())


def emails_to_json(emails: Column) -> Column:
    """Sorted JSON list text."""
    return F.concat(F.lit("["), F.coalesce(json_items(F.array_sort(emails)), F.lit("")), F.lit("]"))


def json_items(items: Column) -> Column:
    """Quoted strings joined by a comma and a blank."""

    def quoted(x: Column) -> Column:
        return F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]\z", "")

    return F.array_join(F.transform(items, quoted), ", ")


def is_json(text: Column) -> Column:
    """Whether a short text is JSON as a whole.

    The parsers stop after the first value, so text behind it is only noticed
    inside brackets; no ending is right inside both kinds.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return listed.isNotNull() & named.isNotNull()


def emails_from_json(text: Column) -> Column:
    """Distinct strictly valid strings of a JSON list; anything else gives an empty list."""
    whole = text.rlike(r"^\s*\[") & is_json(text)
    parsed = F.when(whole, F.from_json(text, "array<string>"))
    return F.array_distinct(F.filter(F.coalesce(parsed, _none()), is_email_strict))


def split_existing(text: Column) -> Column:
    """Comma list to trimmed lower-case items with an @; repeats kept."""
    items = F.transform(F.split(text, ","), storage_key)
    return F.coalesce(F.filter(items, lambda e: F.contains(e, F.lit("@"))), _none())


def _none() -> Column:
    return F.array().cast("array<string>")
