"""Finders: companies in, address rows out, one DataFrame per method.

Built-in finders are column expressions and joins. A user's own finder is any
object with ``name``, ``enabled``, ``find`` and ``attempts``; it may use a
Pandas UDF or ``mapInPandas`` inside.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import patterns as P
from ..functions.domains import domain_static, domain_strict, is_valid_domain
from ..functions.emails import extract_emails
from ..session import written
from ..sources.results import emails_from_results
from .links import page_address, pages_in_scope, site_key
from .queues import has_website, site_domain, with_domain, with_valid_domain
from .rank import top_n_per_group
from .shared import SharedFound, SharedRows
from .skew import dealt, grid_join, hot_keys, salted_join


class Finder(Protocol):
    name: str
    enabled: bool

    def find(self, companies: DataFrame, as_of: str, method_ord: int) -> DataFrame:
        """Rows in the FOUND layout for the companies the finder can work on."""

    def attempts(self, companies: DataFrame) -> DataFrame:
        """(company_id, valid, succeeded) of every company: could it be worked on, did the run not fail."""


def _found(
    rows: DataFrame, method: str, method_ord: int, as_of: str, details: Column, confidence: Column, metadata: Column
) -> DataFrame:
    return rows.select(
        "company_id",
        F.lit(method).alias("method"),
        F.lit(method_ord).alias("method_ord"),
        F.col("seq").cast("long").alias("seq"),
        "email",
        F.lit(method).alias("source"),
        details.alias("source_details"),
        confidence.cast("double").alias("confidence"),
        metadata.alias("metadata"),
        schema.instant(as_of).alias("found_at"),
    )


@dataclass(frozen=True)
class StaticFinder:
    """Role addresses at the company's domain.

    Pattern choice and top k are constants picked by keyword flags, so a run is
    one projection over the companies: no join, window or shuffle.
    """

    min_confidence: float = 0.7
    max_emails: int = 8
    smart: bool = True
    names: tuple[str, ...] | None = None
    categories: tuple[str, ...] | None = None
    confidences: Mapping[str, float] = field(default_factory=dict)
    match: str = "substring"
    enabled: bool = True
    priority: int = 100
    name: str = "static"

    def valid(self, companies: DataFrame) -> DataFrame:
        return with_valid_domain(companies)

    def attempts(self, companies: DataFrame) -> DataFrame:
        usable = F.coalesce(has_website(F.col("website")), F.lit(False))
        valid = usable & is_valid_domain(domain_static(F.col("website")))
        return companies.select(F.col("id").alias("company_id"), valid.alias("valid"), valid.alias("succeeded"))

    def patterns(self) -> Column:
        if self.smart:
            flags = P.category_flags(F.col("name"), F.col("website"), self.match)
            return P.smart_list(*flags, self.min_confidence, self.max_emails, self.confidences)
        chosen = P.override(P.configured(self.names, self.categories, self.min_confidence), self.confidences)
        return P.pattern_list(P.ranked(chosen, self.min_confidence, self.max_emails))

    def find(self, companies: DataFrame, as_of: str, method_ord: int = 0) -> DataFrame:
        rows = self.valid(companies).select(
            F.col("id").alias("company_id"),
            domain_static(F.col("website")).alias("domain"),
            F.posexplode(self.patterns()).alias("seq", "p"),
        )
        rows = rows.withColumn("email", F.concat("p.pattern", F.lit("@"), "domain"))
        metadata = F.create_map(
            F.lit("pattern"), F.col("p.pattern"), F.lit("category"), F.col("p.category"), F.lit("domain"), "domain"
        )
        details = F.concat(F.lit(schema.STATIC_DETAILS), "p.description")
        return _found(rows, self.name, method_ord, as_of, details, F.col("p.confidence"), metadata)


@dataclass(frozen=True)
class HarvestFinder:
    """Addresses from result files another tool left per company (company_id, body)."""

    results: DataFrame
    sources: tuple[str, ...] = ("bing", "duckduckgo", "yahoo", "crtsh", "dnsdumpster", "hackertarget")
    confidence: float = 0.8
    limit: int | None = None
    clean_domains: bool = True
    skip_invalid: bool = True
    enabled: bool = True
    priority: int = 100
    name: str = "harvester"

    def valid(self, companies: DataFrame) -> DataFrame:
        usable = companies.filter(has_website(F.col("website")))
        return with_domain(usable, self.clean_domains, self.skip_invalid)

    def attempts(self, companies: DataFrame) -> DataFrame:
        """A company without any result file failed and stays open."""
        answered = self.results.select("company_id").distinct().withColumn("_answered", F.lit(True))
        rows = companies.select(
            F.col("id").alias("company_id"),
            site_domain(F.col("website"), self.clean_domains, self.skip_invalid).isNotNull().alias("valid"),
        )
        joined = rows.join(answered, "company_id", "left")
        return joined.select("company_id", "valid", (F.col("valid") & F.col("_answered").isNotNull()).alias("succeeded"))

    def find(self, companies: DataFrame, as_of: str, method_ord: int = 1) -> DataFrame:
        # Repeats go before the join, partly on the map side.
        addresses = emails_from_results(dealt(self.results.select("company_id", "body")), ["company_id"])
        targets = self.valid(companies).select(F.col("id").alias("company_id"), "domain")
        hot = hot_keys(self.results, "company_id")
        rows = salted_join(addresses, targets, "company_id", "inner", F.col("email"), hot)
        if self.limit:
            rows = top_n_per_group(rows, ["company_id"], ["email"], self.limit)
        listed = ", ".join(self.sources)
        metadata = F.create_map(F.lit("domain"), F.col("domain"), F.lit("sources"), F.lit(listed))
        details = F.lit(f"Result files from sources: {listed}")
        rows = rows.withColumn("seq", F.lit(0))
        return _found(rows, self.name, method_ord, as_of, details, F.lit(self.confidence), metadata)


@dataclass(frozen=True)
class SiteFinder:
    """Addresses on the archived pages of a company's own site.

    With a depth or a URL cap only pages reached from the site's root count, or
    from the archived page nearest to it where the root is missing; otherwise
    every archived page of the host does.
    """

    pages: DataFrame
    depth: int = -1
    limit_urls: int | None = None
    ignore_queries: bool = True
    confidence: float = 0.9
    limit: int | None = None
    clean_domains: bool = True
    skip_invalid: bool = True
    enabled: bool = True
    priority: int = 100
    name: str = "scraper"

    def valid(self, companies: DataFrame) -> DataFrame:
        usable = companies.filter(has_website(F.col("website")))
        return with_domain(usable, self.clean_domains, self.skip_invalid)

    def attempts(self, companies: DataFrame) -> DataFrame:
        """A company whose site is not in the archive failed and stays open."""
        archived = self.pages.select(domain_strict(F.col("url")).alias("domain")).distinct()
        rows = companies.select(
            F.col("id").alias("company_id"),
            site_domain(F.col("website"), self.clean_domains, self.skip_invalid).alias("domain"),
        )
        known = archived.withColumn("_archived", F.lit(True))
        joined = salted_join(rows, known, "domain", "left", F.col("company_id"), hot_keys(rows, "domain"))
        valid = F.col("domain").isNotNull()
        return joined.select(
            "company_id", valid.alias("valid"), (valid & F.col("_archived").isNotNull()).alias("succeeded")
        )

    def pages_in_scope(self) -> DataFrame:
        if self.depth < 0 and not self.limit_urls:
            return self.pages
        address = page_address(F.col("url"), self.ignore_queries)
        placed = self.pages.withColumns({"_host": domain_strict(F.col("url")), "_address": site_key(address)})
        # Fewest steps, then shortest: the root itself, and where it is missing the page nearest to it.
        steps = F.size(F.split("_address", "/"))
        nearest = F.min(F.struct(steps, F.length("_address"), "_address", "url")).alias("first")
        roots = placed.filter(F.col("_host").isNotNull()).groupBy("_host").agg(nearest).select("first.url")
        reached = pages_in_scope(roots, self.pages, self.depth, self.limit_urls, self.ignore_queries, by_site_key=True)
        kept = reached.select(F.col("host").alias("_host"), F.col("url").alias("_address"))
        return placed.join(kept, ["_host", "_address"], "left_semi").drop("_host", "_address")

    def addresses(self) -> DataFrame:
        """Distinct (domain, email) of the archive; a site of many pages shrinks before any join."""
        return (
            self.pages_in_scope()
            .filter(F.contains("html", F.lit("@")))
            .select(domain_strict(F.col("url")).alias("domain"), F.explode(extract_emails(F.col("html"))).alias("email"))
            .distinct()
        )

    def shared(self, companies: DataFrame) -> SharedRows:
        """What ``find`` gives, before any row is multiplied: one list per host, and its companies."""
        addresses = self.addresses()
        if self.limit:
            addresses = top_n_per_group(addresses, ["domain"], ["email"], self.limit)
        return SharedRows.of(self.valid(companies).select(F.col("id").alias("company_id"), "domain"), addresses)

    def find(self, companies: DataFrame, as_of: str, method_ord: int = 2) -> DataFrame:
        targets = self.valid(companies).select(F.col("id").alias("company_id"), "domain")
        # Hosts of many pages stand for hosts of many addresses: only URLs are read.
        hosts = self.pages.select(domain_strict(F.col("url")).alias("domain"))
        hot = sorted({*hot_keys(targets, "domain"), *hot_keys(hosts, "domain")})
        addresses = self.addresses()
        if self.limit:
            # Companies of one host share one list, so a shared host never multiplies more than the cap.
            addresses = top_n_per_group(addresses, ["domain"], ["email"], self.limit)
        rows = grid_join(targets, addresses, "domain", F.col("company_id"), F.col("email"), hot)
        if self.limit:
            rows = top_n_per_group(rows, ["company_id"], ["email"], self.limit)
        return self._layout(rows, as_of, method_ord)

    def _layout(self, rows: DataFrame, as_of: str, method_ord: int) -> DataFrame:
        metadata = F.create_map(
            F.lit("domain"), F.col("domain"), F.lit("crawl_depth"), F.lit(str(self.depth))
        )
        details = F.lit(f"{schema.SITE_DETAILS}{self.depth}")
        rows = rows.withColumn("seq", F.lit(0))
        return _found(rows, self.name, method_ord, as_of, details, F.lit(self.confidence), metadata)

    def split(self, companies: DataFrame, as_of: str, method_ord: int) -> tuple[DataFrame, SharedFound]:
        """What ``find`` gives without a cap: the rows of companies with several domains or no id, and all others unmultiplied."""
        targets = self.valid(companies).groupBy(F.col("id").alias("company_id"), "domain").agg(F.count(F.lit(1)).alias("copies"))
        targets = written(targets, "site-targets")
        addresses = written(self.addresses().filter(F.col("domain").isNotNull()), "site-addresses")
        domains = F.min("domain").alias("domain"), F.max("domain").alias("_last"), F.sum("copies").alias("copies")
        per = targets.filter(F.col("company_id").isNotNull()).groupBy("company_id").agg(*domains)
        members = written(per.filter(F.col("domain") == F.col("_last")).drop("_last"), "site-members")
        others = targets.join(members.select("company_id"), "company_id", "left_anti")
        shared = SharedFound(members, addresses, self.name, method_ord, lambda rows: self._layout(rows, as_of, method_ord))
        return replace(shared, members=others).found(), shared


class Registry:
    """Finders by name. They run in the order asked for, else by priority (low first), then as added.

    The order decides which finder an address found twice belongs to.
    """

    def __init__(self, *finders: Finder):
        self.finders: dict[str, Finder] = {}
        for finder in finders:
            self.add(finder)

    def add(self, finder: Finder) -> None:
        self.finders[finder.name] = finder

    def available(self) -> list[str]:
        return list(self.finders)

    def selected(self, methods: list[str] | None = None) -> list[tuple[int, Finder]]:
        """Enabled finders among the wanted methods with their order; unknown names are skipped."""
        if methods is None:
            known = sorted(self.finders.values(), key=lambda f: getattr(f, "priority", 100))
        else:
            known = [self.finders[m] for m in dict.fromkeys(methods) if m in self.finders]
        return list(enumerate(f for f in known if f.enabled))
