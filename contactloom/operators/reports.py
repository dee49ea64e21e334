"""Counts and summaries, each from as few pruned scans as it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from .queues import has_website
from .store import domain_members


def _count(test: Column | None = None) -> Column:
    return F.count(F.lit(1)) if test is None else F.count_if(test)


def _rows(totals: DataFrame, names: dict[str, str]) -> DataFrame:
    """One-row totals to (metric, count) rows."""
    pairs = F.array(
        *[F.struct(F.lit(label).alias("metric"), F.col(c).alias("count")) for c, label in names.items()]
    )
    return totals.select(F.inline(pairs))


def email_stats(emails: DataFrame) -> DataFrame:
    """total, checked, unchecked, companies (one scan of two columns), and one row per source."""
    checked = F.col("checked_at").isNotNull()
    per_source = emails.groupBy("source").agg(_count().alias("n"))
    totals = emails.agg(
        _count().alias("total_emails"),
        _count(checked).alias("checked_emails"),
        _count(~checked).alias("unchecked_emails"),
        F.count_distinct("company_id").alias("companies_with_emails"),
    )
    sources = per_source.select(F.concat(F.lit("source:"), "source").alias("metric"), F.col("n").alias("count"))
    return _rows(totals, {c: c for c in totals.columns}).unionByName(sources)


def by_source(emails: DataFrame) -> DataFrame:
    return emails.groupBy("source").agg(_count().alias("n"))


def check_stats(emails: DataFrame) -> DataFrame:
    """Per source, and over all as source NULL, from one scan."""
    checked = F.col("checked_at").isNotNull()
    return emails.rollup("source").agg(
        _count().alias("total_emails"),
        _count(checked).alias("checked_emails"),
        _count(~checked).alias("unchecked_emails"),
        _count(F.col("check_error").isNotNull()).alias("error_emails"),
    )


def companies_with_emails(emails: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return emails.agg(count("company_id").alias("n_companies"))


def metric_report(companies: DataFrame, emails: DataFrame) -> DataFrame:
    """Seven (metric, count) rows; "checked" means a reachability is known."""
    website = F.col("website")
    company_totals = companies.agg(
        _count().alias("companies"), _count(has_website(website) & (website != "N/A")).alias("with_website")
    )
    source = F.col("source")
    email_totals = emails.agg(
        _count().alias("emails"),
        _count(source == "static").alias("static"),
        _count(source == "harvester").alias("harvester"),
        _count(source == "scraper").alias("scraper"),
        _count(F.col("is_reachable").isNotNull()).alias("checked"),
    )
    company_rows = _rows(company_totals, schema.COMPANY_METRICS)
    email_rows = _rows(email_totals, schema.EMAIL_METRICS)
    return company_rows.unionByName(email_rows)


def domain_sizes(emails: DataFrame, column: str = "email") -> DataFrame:
    """Distinct addresses per domain; counted after the distinct, so no set is built."""
    return domain_members(emails, column).groupBy("domain").agg(_count().alias("n_emails"))


def found_per_domain(domains: DataFrame, found: DataFrame) -> DataFrame:
    """Every processed domain with the number of distinct addresses found for it."""
    sizes = found.select("domain", "email").distinct().groupBy("domain").agg(_count().alias("n_emails"))
    joined = domains.select("domain").distinct().join(sizes, "domain", "left")
    return joined.select("domain", F.coalesce("n_emails", F.lit(0)).cast("long").alias("n_emails"))


def domain_summary(sizes: DataFrame) -> DataFrame:
    """Totals over per-domain sizes; an address of two domains counts twice."""
    with_emails = _count(F.col("n_emails") > 0)
    return sizes.agg(
        _count().alias("total_domains"),
        with_emails.alias("domains_with_emails"),
        F.coalesce(F.sum("n_emails"), F.lit(0)).alias("total_emails"),
        F.coalesce(F.round(F.try_divide(with_emails * 100.0, _count()), 1), F.lit(0.0)).alias("success_rate"),
    )


def top_domains(sizes: DataFrame, n: int = 10) -> DataFrame:
    return sizes.filter(F.col("n_emails") > 0).orderBy(F.desc("n_emails"), "domain").limit(n)


def found_per_method(found: DataFrame) -> DataFrame:
    return found.groupBy("company_id", "method").agg(_count().alias("n"))


def workflow_counters(companies: DataFrame, found: DataFrame, methods: list[str], counted: DataFrame | None = None) -> DataFrame:
    """Per company: addresses found before any dedup, and the methods that ran.

    Counted per company and method first (``counted``, where that is known), so a company of many rows is small
    before it is gathered.
    """
    per_method = found_per_method(found) if counted is None else counted
    per_company = per_method.groupBy("company_id").agg(F.sum("n").alias("n"), _count().alias("m"))
    ids = companies.select(F.col("id").alias("company_id"))
    return ids.join(per_company, "company_id", "left").select(
        "company_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("emails_found"),
        F.coalesce("m", F.lit(0)).cast("long").alias("methods_with_emails"),
        F.lit(",".join(methods)).alias("methods_used"),
    )


def workflow_totals(counters: DataFrame, checked: DataFrame) -> DataFrame:
    """Companies processed, addresses found, and found addresses with a good reply."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = counters.select(one.alias("c"), F.col("emails_found").alias("f"), none.alias("k")).unionByName(
        checked.select(none.alias("c"), none.alias("f"), one.alias("k"))
    )
    return rows.agg(
        F.sum("c").alias("companies_processed"),
        F.sum("f").alias("total_emails_found"),
        F.sum("k").alias("total_emails_checked"),
    )


def run_counts(found: DataFrame, added: DataFrame) -> DataFrame:
    """Per company of a run: found by the method, taken from the list, newly stored."""
    listed = F.col("source") == "existing"
    counted = found.groupBy("company_id").agg(
        _count(~listed).alias("n_found"), _count(listed).alias("n_existing")
    )
    stored = added.groupBy("company_id").agg(_count().alias("n"))
    return counted.join(stored, "company_id", "left").select(
        "company_id", "n_found", "n_existing", F.coalesce("n", F.lit(0)).cast("long").alias("n_stored")
    )


def by_query(companies: DataFrame) -> DataFrame:
    return companies.groupBy("search_query").agg(_count().alias("n"))


def runs_to_expire(manifest: DataFrame, keep: int) -> DataFrame:
    """All but the newest runs; names that are no ``YYYY-MM-DD_HHMMSS`` stamp never expire.

    Only the kept rows are ranked and broadcast: ``keep`` rows, whatever the
    length of the manifest.
    """
    stamp = F.try_to_timestamp("run_name", F.lit("yyyy-MM-dd_HHmmss"))
    shaped = F.col("run_name").rlike(r"^\d{4}-\d{2}-\d{2}_\d{6}\z")
    runs = manifest.filter(shaped & stamp.isNotNull())
    newest = runs.orderBy(F.desc("created_at"), "path").limit(keep).select("path")
    return runs.join(F.broadcast(newest), "path", "left_anti")
