"""Work queues and company gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domains import domain_record, domain_static, domain_strict, is_valid_domain
from ..functions.emails import is_json
from .rank import capped_first, top_n_per_group


def method_list(stored: Column) -> Column:
    """Method names from JSON text; NULL and text that as a whole is no JSON list count as none."""
    parsed = F.when(is_json(stored), F.from_json(stored, "array<string>"))
    return F.coalesce(parsed, F.array().cast("array<string>"))


def _completed(methods: Column, method: Column) -> Column:
    return F.exists(F.coalesce(methods, F.array().cast("array<string>")), lambda m: F.lower(m) == F.lower(method))


def has_website(website: Column) -> Column:
    return website.isNotNull() & (website != "")


def has_real_website(website: Column) -> Column:
    """Also rules out the missing-value marker in any case, and a lone ``n``."""
    return has_website(website) & ~website.ilike("%n/a%") & (F.lower(website) != "n")


def open_for(companies: DataFrame, method: str) -> DataFrame:
    """Companies with a real website and the method not completed, in no order.

    ``companies.email_methods_completed`` is an array.
    """
    open_ = has_real_website(F.col("website")) & ~_completed(F.col("email_methods_completed"), F.lit(method))
    return companies.filter(open_)


def bulk_queue(companies: DataFrame, method: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """The open companies by id, or a page of them."""
    return capped_first(open_for(companies, method), ["id"], limit, offset)


def needing_method(companies: DataFrame, method: str, limit: int | None = None) -> DataFrame:
    """The looser queue: any non-empty website will do."""
    open_ = has_website(F.col("website")) & ~_completed(F.col("email_methods_completed"), F.lit(method))
    return capped_first(companies.filter(open_).select("id", "name", "website"), ["id"], limit)


def needing_any_method(companies: DataFrame, methods: list[str], limit: int | None = None) -> DataFrame:
    """One row per company and open method, from one scan; the limit counts per method."""
    done = F.col("email_methods_completed")
    wanted = F.array(*[F.lit(m) for m in methods])
    rows = companies.filter(has_website(F.col("website"))).select(
        "id", "name", "website", F.explode(F.filter(wanted, lambda m: ~_completed(done, m))).alias("needed_method")
    )
    return top_n_per_group(rows, ["needed_method"], ["id"], limit) if limit else rows


def never_checked(emails: DataFrame, source: str | None = None) -> DataFrame:
    open_ = emails.filter(F.col("checked_at").isNull())
    return open_.filter(F.col("source") == source) if source else open_


def unchecked(emails: DataFrame, limit: int | None = None, source: str | None = None) -> DataFrame:
    """Addresses never checked, oldest first."""
    return capped_first(never_checked(emails, source), ["created_at", "id"], limit)


def budget(emails: DataFrame, max_requests: int | None, source: str | None = None) -> DataFrame:
    """The part of the queue a request budget covers; 0 or None covers all."""
    return unchecked(emails, max_requests, source)


def of_company(emails: DataFrame, company_id: int, source: str | None = None) -> DataFrame:
    """Addresses of one company, newest first."""
    rows = emails.filter(F.col("company_id") == company_id)
    if source:
        rows = rows.filter(F.col("source") == source)
    return rows.orderBy(F.desc("created_at"), F.desc("id"))


def with_valid_domain(companies: DataFrame, clean: bool = True) -> DataFrame:
    """Companies a finder can work on; without cleaning any website will do."""
    website = F.col("website")
    if not clean:
        return companies.filter(has_website(website))
    return companies.filter(has_website(website) & is_valid_domain(domain_static(website)))


def site_domain(website: Column, clean: bool = True, skip_invalid: bool = True) -> Column:
    """Domain of a company under the invalid-domain policy; NULL drops the company."""
    if clean and skip_invalid:
        return domain_strict(website)
    domain = F.coalesce(domain_strict(website), website) if clean else domain_record(website)
    return F.nullif(domain, F.lit(""))


def with_domain(companies: DataFrame, clean: bool = True, skip_invalid: bool = True) -> DataFrame:
    """Adds ``domain`` and drops companies without one."""
    domain = site_domain(F.col("website"), clean, skip_invalid)
    return companies.withColumn("domain", domain).filter(F.col("domain").isNotNull())
