"""Listing fields: the first candidate that passes the test of its field wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import DIGIT, SPACE
from ..functions.domains import domain_naive, domain_static, is_valid_domain
from ..functions.text import MISSING, clean_email, clean_phone, clean_text, clean_website, strip
from .rank import top_n_per_group
from .store import new_companies


def _first(tests: list[tuple[Column, Column]], default: Column) -> Column:
    return F.coalesce(*[F.when(test, value) for test, value in tests], default)


def _not_results(c: Column) -> Column:
    return F.lower(c) != "results"


def _first_fit(values: list[Column], fits: Callable[[Column], Column]) -> Column:
    """The first value that fits; each value is worked out once."""
    return F.get(F.filter(F.array(*values), fits), 0)


def _usable(name: Column) -> Column:
    return (F.length(name) > 1) & _not_results(name)


def listing_name(label: Column, href: Column, child: Column) -> Column:
    """Label, else the place part of the link, else inner text; NULL when unusable."""
    part = F.regexp_extract(href, r"/maps/place/([^/]*)", 1)
    # A percent sign that starts no escape stands for itself.
    decoded = F.try_url_decode(F.regexp_replace(part, r"%(?![0-9A-Fa-f]{2})", "%25"))
    picked = _first_fit([strip(label), strip(decoded), strip(child)], _usable)
    return _first_fit([clean_text(picked)], lambda n: _usable(n) & (n != MISSING))


def detail_name(heads: list[Column], title: Column, fallback: Column, title_suffix: str) -> Column:
    """Heading of fitting length, else the page title less its suffix, else the fallback."""
    head = _first_fit(
        [strip(h) for h in heads],
        lambda t: F.length(t).between(2, 100) & _not_results(t) & ~t.startswith("Results"),
    )
    short = F.when(F.contains(title, F.lit(title_suffix)), F.replace(title, F.lit(title_suffix), F.lit("")))
    later = _first_fit([strip(short), fallback], lambda t: (t != "") & _not_results(t))
    return F.coalesce(head, later, F.lit("Unknown Business"))


def detail_address(texts: list[Column]) -> Column:
    return _first([(t.rlike("St|Ave|Rd|Australia"), strip(t)) for t in texts], F.lit(MISSING))


def detail_website(values: list[Column]) -> Column:
    def fits(v: Column) -> Column:
        return F.contains(v, F.lit(".")) & ~v.startswith("javascript:")

    return _first([(fits(v), strip(v)) for v in values], F.lit(MISSING))


def detail_phone(candidates: list[tuple[str, Column]]) -> Column:
    """Candidates are ("link", href) or ("text", text) in order of trust."""
    tests = []
    for kind, value in candidates:
        if kind == "link":
            tests.append((value.startswith("tel:"), strip(F.replace(value, F.lit("tel:"), F.lit("")))))
        else:
            tests.append((value.rlike(rf"[+{DIGIT}]"), strip(value)))
    return _first(tests, F.lit(MISSING))


def detail_rating(texts: list[Column]) -> Column:
    return _first(
        [(F.contains(t, F.lit(".")) & (F.length(t) <= 5), strip(t)) for t in texts], F.lit(MISSING)
    )


def review_count(contents: list[Column]) -> Column:
    """Digits directly before ``review``; a thousands separator cuts the number."""
    found = [F.nullif(F.regexp_extract(c, rf"({DIGIT}+)[{SPACE}]*review", 1), F.lit("")) for c in contents]
    return F.coalesce(*found, F.lit(MISSING))


def review_count_fixed(contents: list[Column]) -> Column:
    """The whole number, thousands separators read."""
    grouped = rf"({DIGIT}+(?:[.,]{DIGIT}{{3}})*)[{SPACE}]*review"
    found = [F.nullif(F.regexp_extract(c, grouped, 1), F.lit("")) for c in contents]
    return F.translate(F.coalesce(*found), ",.", "").cast("long")


def detail_category(texts: list[Column]) -> Column:
    return _first([(F.length(t).between(1, 99), strip(t)) for t in texts], F.lit(MISSING))


def guess_email(domain: Column, with_static: bool = True) -> Column:
    """``info@`` at the domain; the static finder ranks that pattern first."""
    cleaned = domain_static(domain)
    plain = F.regexp_replace(F.lower(domain), r"^www\.", "")
    tests = [(F.contains(domain, F.lit(".")), F.concat(F.lit("info@"), plain))]
    if with_static:
        tests.insert(0, (is_valid_domain(cleaned), F.concat(F.lit("info@"), cleaned)))
    return _first(tests, F.lit(MISSING))


def company_record(details: DataFrame) -> DataFrame:
    """Cleaned record with an address guess; other columns are kept."""
    cleaned = {
        "name": clean_text(F.col("name")),
        "address": clean_text(F.col("address")),
        "phone": clean_phone(F.col("phone")),
        "website": clean_website(F.col("website")),
        "rating": clean_text(F.col("rating")),
        "review_count": clean_text(F.col("review_count")),
        "category": clean_text(F.col("category")),
    }
    kept = [c for c in details.columns if c not in cleaned and c != "email"]
    record = details.select(*kept, *[cleaned[c].alias(c) for c in cleaned])
    # In steps, so the cleaned website is worked out once, not once per use.
    site = F.when(F.col("website") != MISSING, domain_naive(F.col("website")))
    guessed = record.withColumn("_site", site).withColumn("_guess", guess_email(F.col("_site")))
    return guessed.withColumn("email", clean_email(F.col("_guess"))).drop("_site", "_guess")


def accepted_per_query(
    listings: DataFrame, stored: DataFrame, n: int, arrival: list[str], name: str = "name"
) -> DataFrame:
    """The first n accepted listings of each query; rejects do not count."""
    usable = listings.filter(F.col(name).isNotNull())
    return top_n_per_group(new_companies(usable, stored, arrival), ["search_query"], arrival, n)
