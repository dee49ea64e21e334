"""Merging into the address and company tables: dedup, anti joins, keyed updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions.emails import is_email_strict
from ..functions.domains import domain_normalized
from ..functions.text import storage_key
from .rank import first_wins
from .skew import hot_keys, salted_join

EMAIL_KEY = ["company_id", "email"]
# Listed addresses come after all found ones of the same method.
EXISTING_SEQ = 1 << 40
# Two key columns of at most some hundred bytes a row.
BROADCAST_ROWS = 500_000


def dedupe_first(found: DataFrame, order: list[str], keep: str = "first") -> DataFrame:
    """One row per (company, stored address): the first to arrive, or the most confident."""
    keyed = found.withColumn("email", storage_key(F.col("email")))
    ranking = [F.desc("confidence"), *order] if keep == "best" else order
    return first_wins(keyed, EMAIL_KEY, ranking)


def email_id(company_id: Column, email: Column) -> Column:
    """Repeatable id from the natural key."""
    return F.xxhash64(company_id, email)


def new_email_rows(found: DataFrame, stored: DataFrame, order: list[str], keep: str = "first") -> DataFrame:
    """Found addresses not stored yet, in the layout of the table.

    Dedup and anti join share the shuffle on (company_id, email).
    """
    return email_rows(dedupe_first(found, order, keep).join(stored.select(*EMAIL_KEY), EMAIL_KEY, "left_anti"))


def not_stored(batch: DataFrame, n_rows: int, stored: DataFrame) -> DataFrame:
    """Rows of a deduped, written batch that a (much larger) store lacks.

    A batch of checked size is broadcast, so the store is scanned in place and
    only its matches move. A larger batch meets the store in a shuffle.
    """
    known = stored.select(*EMAIL_KEY)
    if n_rows <= BROADCAST_ROWS:
        known = known.join(F.broadcast(batch.select(*EMAIL_KEY)), EMAIL_KEY, "left_semi")
    return batch.join(known, EMAIL_KEY, "left_anti")


def email_rows(fresh: DataFrame) -> DataFrame:
    """Deduped finder rows in the layout of the address table."""
    columns = set(fresh.columns)
    if "metadata" in columns and isinstance(fresh.schema["metadata"].dataType, T.MapType):
        filled = F.size("metadata") > 0
        fresh = fresh.withColumn("metadata", F.when(filled, F.to_json("metadata")))
    if "found_at" in columns:
        fresh = fresh.withColumnRenamed("found_at", "created_at")
    fresh = fresh.withColumn("id", email_id(F.col("company_id"), F.col("email")))
    return schema.conform(fresh, schema.EMAILS).select(*schema.EMAILS.fieldNames())


def new_companies(listings: DataFrame, stored: DataFrame, arrival: list[str]) -> DataFrame:
    """Listings whose (name, search_query) is neither stored nor seen earlier in the batch."""
    key = ["name", "search_query"]
    return first_wins(listings, key, arrival).join(stored.select(*key), key, "left_anti")


def merge_existing(found: DataFrame, existing: DataFrame, method: str, method_ord: int, as_of: str) -> DataFrame:
    """Found addresses plus the listed ones of the company that were not found."""
    known = found.select("company_id", F.lower("email").alias("_key")).distinct()
    listed = existing.withColumn("_key", F.lower("email")).join(known, ["company_id", "_key"], "left_anti")
    rows = listed.select(
        "company_id",
        F.lit(method).alias("method"),
        F.lit(method_ord).alias("method_ord"),
        (F.col("place") + F.lit(EXISTING_SEQ)).alias("seq"),
        "email",
        F.lit("existing").alias("source"),
        F.lit(schema.EXISTING_DETAILS).alias("source_details"),
        F.lit(0.95).alias("confidence"),
        F.create_map(*[F.lit(x) for pair in schema.EXISTING_ORIGIN.items() for x in pair]).alias("metadata"),
        schema.instant(as_of).alias("found_at"),
    )
    return found.unionByName(rows)


def match_replies(emails: DataFrame, replies: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Stored addresses with their reply, matched on the storage key.

    Of several replies to one address the first in ``order`` counts.
    """
    keyed = replies.withColumn("email", storage_key(F.col("email")))
    if order:
        keyed = first_wins(keyed, EMAIL_KEY, order)
    carried = [c for c in keyed.columns if c not in emails.columns]
    return emails.join(keyed.select(*EMAIL_KEY, *carried), EMAIL_KEY)


def _domain_part(value: Column) -> Column:
    return F.lower(F.split_part(value, F.lit("@"), F.lit(2)))


def in_domain(emails: DataFrame, target: str, column: str = "email") -> DataFrame:
    """Strictly valid addresses of one domain; the cheap comparison goes first."""
    value = F.col(column)
    return emails.filter((_domain_part(value) == domain_normalized(F.lit(target))) & is_email_strict(value))


def in_domains(emails: DataFrame, targets: DataFrame, column: str = "email", target: str = "target") -> DataFrame:
    """Strictly valid addresses whose domain is among the targets; only matches are judged."""
    value = F.col(column)
    facts = emails.withColumn("_domain", _domain_part(value))
    wanted = targets.select(domain_normalized(F.col(target)).alias("_domain")).distinct()
    matched = salted_join(facts, wanted, "_domain", "left_semi", value, hot_keys(facts, "_domain"))
    return matched.drop("_domain").filter(is_email_strict(value))


def orphans(emails: DataFrame, companies: DataFrame) -> DataFrame:
    """Addresses whose company is missing."""
    known = companies.select(F.col("id").alias("company_id"))
    hot = hot_keys(emails, "company_id")
    return salted_join(emails, known, "company_id", "left_anti", F.col("email"), hot)


def apply_check_results(
    emails: DataFrame, results: DataFrame, as_of: str, key: list[str] = ["id"]
) -> DataFrame:
    """New snapshot of the addresses.

    A success overwrites the result columns and leaves an old ``check_error``;
    an error writes only ``check_error``. Both set ``checked_at``. Of several
    results for one key a success counts before an error, so rows never multiply.
    """
    fields = [*schema.CHECK_RESULTS, "check_error", "is_error"]
    single = first_wins(results, key, ["is_error", F.xxhash64(*fields)])
    fresh = single.select(*key, *[F.col(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_hit"))
    joined = emails.join(fresh, key, "left")
    hit = F.col("_hit").isNotNull()
    failed = F.coalesce(F.col("_new_is_error"), F.lit(False))

    def value(column: str) -> Column:
        old = F.col(column)
        if column == "checked_at":
            return F.when(hit, schema.instant(as_of)).otherwise(old).alias(column)
        if column == "check_error":
            return F.when(failed, F.col("_new_check_error")).otherwise(old).alias(column)
        if column in schema.CHECK_RESULTS:
            return F.when(hit & ~failed, F.col(f"_new_{column}")).otherwise(old).alias(column)
        return old

    return joined.select(*[value(c) for c in emails.columns])


def update_methods(companies: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """New snapshot of the companies with the methods of a run log added in order.

    ``runs`` holds (company_id, method, completed, run_no). It is reduced to one
    row per company and method before anything is gathered, so the lists hold
    as many items as there are methods.
    """
    per_method = runs.groupBy("company_id", "method").agg(
        F.min("run_no").alias("first_used"),
        F.min(F.when(F.col("completed"), F.col("run_no"))).alias("first_done"),
    )

    def in_order(position: str) -> Column:
        steps = F.collect_list(F.when(F.col(position).isNotNull(), F.struct(position, "method")))
        return F.transform(F.array_sort(steps), lambda s: s["method"])

    per_company = per_method.groupBy(F.col("company_id").alias("id")).agg(
        in_order("first_used").alias("_used"), in_order("first_done").alias("_done")
    )
    joined = companies.join(per_company, "id", "left")
    none = F.array().cast("array<string>")

    def extended(old: str, new: str) -> Column:
        merged = F.array_distinct(F.concat(F.coalesce(F.col(old), none), F.col(new)))
        return F.when(F.col("_used").isNull(), F.col(old)).otherwise(merged)

    updated = {
        "email_methods_used": extended("email_methods_used", "_used"),
        "email_methods_completed": extended("email_methods_completed", "_done"),
        "last_email_scan": F.when(F.col("_used").isNotNull(), schema.instant(as_of)).otherwise(
            F.col("last_email_scan")
        ),
    }
    return joined.select(*[updated.get(c, F.col(c)).alias(c) for c in companies.columns])


def union_emails(*sets: DataFrame) -> DataFrame:
    """Distinct addresses of many sets, without case folding."""
    result = sets[0].select("email")
    for further in sets[1:]:
        result = result.unionByName(further.select("email"))
    return result.distinct()


def domain_members(emails: DataFrame, column: str = "email") -> DataFrame:
    """Distinct (domain, address) of strictly valid addresses.

    One row per member instead of one set per domain: a domain may hold a third
    of all addresses and would not fit a cell. The domain follows from the
    address, so only addresses are shuffled, and each is judged once.
    """
    distinct = emails.select(F.col(column).alias("email")).distinct()
    valid = distinct.filter(is_email_strict(F.col("email")))
    return valid.select(_domain_part(F.col("email")).alias("domain"), "email")
