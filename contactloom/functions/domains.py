"""Five ways to read a domain from a website value, and two validity tests.

They differ in case, port, ``www.`` and user info on purpose; pipelines use
``domain_strict``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import DOMAIN, DOMAIN_STRICT
from .text import strip


def _without_breaks(c: Column, *schemes: str) -> Column:
    """A URL with a known scheme loses tabs and line breaks anywhere in it."""
    known = [c.startswith(f"{scheme}://") for scheme in schemes]
    return F.when(reduce(or_, known), F.translate(c, "\t\r\n", "")).otherwise(c)


def domain_record(website: Column) -> Column:
    """Authority of the URL (``http://`` assumed), lower, no ``www.``; keeps port and user."""
    raw = F.translate(website, "\t\r\n", "")
    with_scheme = F.regexp_extract(raw, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)
    bare = F.regexp_extract(raw, r"^[^/?#]*", 0)
    host = F.lower(F.when(website.startswith("http"), with_scheme).otherwise(bare))
    return F.when(website != "", F.regexp_replace(host, r"^www\.", ""))


def domain_static(website: Column) -> Column:
    """Host part, ``www.`` dropped before lowering, trimmed last; blank stays ''."""
    text = _without_breaks(website, "http", "https")
    host = F.regexp_extract(text, r"^(?:https?://)?+(?:www\.)?+([^/?#]*)", 1)
    return F.coalesce(strip(F.lower(host)), F.lit(""))


def domain_strict(website: Column) -> Column:
    """Trimmed first; NULL unless a well-formed name with at least one dot."""
    text = _without_breaks(strip(website), "http", "https")
    host = F.regexp_extract(text, r"^(?:https?://)?+(?:www\.)?+([^/?#]*)", 1)
    return F.when(host.rlike(DOMAIN), F.lower(host))


def domain_normalized(website: Column) -> Column:
    """As the strict form, but also ``ftp(s)://``, no port, and no validity test."""
    text = _without_breaks(strip(website), "http", "https", "ftp", "ftps")
    host = F.regexp_extract(text, r"^(?:(?:https?|ftps?)://)?+(?:www\.)?+([^/?#:]*)", 1)
    return F.nullif(F.lower(host), F.lit(""))


def domain_naive(website: Column) -> Column:
    """Schemes removed anywhere, text before the first slash."""
    bare = F.replace(F.replace(website, F.lit("http://"), F.lit("")), F.lit("https://"), F.lit(""))
    return F.substring_index(bare, "/", 1)


def is_valid_domain(domain: Column) -> Column:
    """Labels of 1-63 letters, digits and inner hyphens, at least one dot."""
    return F.coalesce(domain.rlike(DOMAIN), F.lit(False))


def is_valid_domain_strict(domain: Column) -> Column:
    """Validity of the normalised form, with a last label of two or more."""
    return F.coalesce(domain_normalized(domain).rlike(DOMAIN_STRICT), F.lit(False))


