"""Text cleaning: names, phones, addresses, file names, log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import ANSI_CODE, DIGIT, SPACE, SPACE_CHARS, WORD

MISSING = "N/A"


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` drops blanks only)."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def storage_key(c: Column) -> Column:
    """The form an address is stored and compared in."""
    return strip(F.lower(c))


def _or_missing(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(MISSING))


def clean_text(c: Column) -> Column:
    """Printable ASCII and Latin-1 only, single blanks; empty becomes N/A."""
    kept = F.regexp_replace(c, r"[^\x20-\x7E\u00a0-\u00ff]", "")
    return _or_missing(F.trim(F.regexp_replace(kept, r"[ \u00a0]+", " ")))


def clean_phone(c: Column) -> Column:
    """Digits, blanks, hyphens, brackets and plus signs."""
    kept = F.regexp_replace(c, rf"[^{DIGIT}{SPACE}\-()+]", "")
    return _or_missing(F.trim(F.regexp_replace(kept, rf"[{SPACE}]+", " ")))


def clean_email(c: Column) -> Column:
    """Word characters, dots, hyphens and @; N/A without an @."""
    kept = F.regexp_replace(c, rf"[^{WORD}.\-@]", "")
    return F.when(F.contains(kept, F.lit("@")), kept).otherwise(F.lit(MISSING))


def clean_website(c: Column) -> Column:
    """Word characters and ``.-/:?=&%``."""
    return _or_missing(F.regexp_replace(c, rf"[^{WORD}.\-/:?=&%]", ""))


def display_list(c: Column, shown: int = 10) -> Column:
    """Sorted, the first ``shown`` named, the rest counted."""
    items = F.array_sort(c)
    head = F.array_join(F.slice(items, 1, shown), ", ")
    more = F.concat(head, F.lit(" ... and "), (F.size(items) - shown).cast("string"), F.lit(" more"))
    return (
        F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.lit("No emails"))
        .when(F.size(items) <= shown, head)
        .otherwise(more)
    )


def safe_name(c: Column) -> Column:
    """A value usable as a file name."""
    replaced = F.translate(c, '<>:"/\\|?*', "_________")
    stripped = F.btrim(replaced, F.lit(" ."))
    return F.coalesce(F.nullif(stripped, F.lit("")), F.lit("unnamed"))


def strip_ansi(c: Column) -> Column:
    """Drop terminal colour codes and line ends."""
    return F.regexp_replace(F.regexp_replace(c, r"[\r\n]+\z", ""), ANSI_CODE, "")
