"""Finding addresses by several methods, storing them, tracking what ran."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..operators import queues, reports, store
from ..operators.finders import Finder, Registry, SiteFinder
from ..operators.shared import SharedFound
from ..operators.skew import dealt
from ..session import written
from ..sources.results import existing_emails
from .check import Checker, ReplyLogChecker

ARRIVAL = ["method_ord", "seq"]


def find_emails(
    companies: DataFrame, registry: Registry, as_of: str, methods: list[str] | None = None
) -> DataFrame:
    """Union of the selected finders; companies a finder cannot use give no rows."""
    result = None
    for method_ord, finder in registry.selected(methods):
        rows = finder.find(companies, as_of, method_ord)
        result = rows if result is None else result.unionByName(rows)
    return schema.empty_table(companies.sparkSession, schema.FOUND) if result is None else result


def _find_parts(
    companies: DataFrame, finders: list[tuple[int, Finder]], as_of: str
) -> tuple[DataFrame, SharedFound | None]:
    """What the finders give: rows, and those of a site finder unmultiplied.

    A host of m companies with a addresses is m * a rows, so nothing that only
    counts, compares or tracks makes them.
    """
    shared = None
    rows = schema.empty_table(companies.sparkSession, schema.FOUND)
    for method_ord, finder in finders:
        if shared is None and isinstance(finder, SiteFinder) and not finder.limit:
            found, shared = finder.split(companies, as_of, method_ord)
        else:
            found = finder.find(companies, as_of, method_ord)
        rows = rows.unionByName(found)
    return rows, shared


def run_log(
    companies: DataFrame, found: DataFrame, finders: list[tuple[int, Finder]], track_policy: str
) -> DataFrame:
    """(company_id, method, completed, run_no) of a run; ``found`` needs company_id, method and method_ord.

    ``cli``: every queued company was tried and is completed unless its run
    failed. ``finder``: only valid companies are tracked. ``workflow``: only
    companies with addresses are.
    """
    if track_policy == "workflow":
        return found.select(
            "company_id", "method", F.lit(True).alias("completed"), F.col("method_ord").alias("run_no")
        )
    result = None
    for method_ord, finder in finders:
        tried = finder.attempts(companies)
        # Under ``cli`` a company without a usable domain has nothing left to try.
        completed = F.col("succeeded") if track_policy == "finder" else F.col("succeeded") | ~F.col("valid")
        rows = tried.filter(F.col("valid")) if track_policy == "finder" else tried
        rows = rows.select(
            "company_id", F.lit(finder.name).alias("method"), completed.alias("completed"), F.lit(method_ord).alias("run_no")
        )
        result = rows if result is None else result.unionByName(rows)
    return result


def _added(found: DataFrame, shared: SharedFound | None, stored: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Found addresses the store lacks, and what is taken of the shared ones: stored, or found by an earlier method.

    A small batch leaves the store where it is.
    """
    batch = written(store.dedupe_first(found, ARRIVAL), "batch")
    n_rows, taken = batch.count(), None
    if shared is not None:
        earlier = F.coalesce(F.col("method_ord") < shared.method_ord, F.lit(True))
        first = batch.filter(earlier)
        taken = shared.inside(first.select(*store.EMAIL_KEY).unionByName(stored.select(*store.EMAIL_KEY)))
        later = batch.filter(~earlier)
        batch = first.unionByName(later.join(shared.inside(later), store.EMAIL_KEY, "left_anti"))
    return store.email_rows(store.not_stored(batch, n_rows, stored)), taken


def _marks(shared: SharedFound) -> DataFrame:
    """A row for each company with shared addresses, as the run log reads found rows."""
    return shared.counts().select("company_id", "method", F.lit(shared.method_ord).alias("method_ord"))


@dataclass(frozen=True)
class BulkResult:
    found: DataFrame
    added: DataFrame
    companies: DataFrame
    counts: DataFrame


def bulk_find(
    companies: DataFrame,
    stored: DataFrame,
    finder: Finder,
    as_of: str,
    limit: int | None = None,
    offset: int = 0,
    existing: bool = True,
    track_policy: str = "cli",
) -> BulkResult:
    """One method over its work queue: find, merge listed addresses, dedup, track.

    Found rows are written once, since counting, storing and tracking all read them.
    """
    if limit or offset:
        queue = written(queues.bulk_queue(companies, finder.name, limit, offset), "queue")
    else:
        queue = queues.open_for(companies, finder.name)
    named = dealt(queue.withColumn("name", F.coalesce("name", F.lit(schema.UNNAMED_COMPANY))))
    found, shared = _find_parts(named, [(0, finder)], as_of)
    if existing and "existing" in companies.columns:
        listed = existing_emails(named)
        if shared is not None:
            known = shared.inside(listed.withColumn("email", F.lower("email")))
            known = known.select("company_id", F.col("email").alias("_key"))
            listed = listed.withColumn("_key", F.lower("email")).join(known, ["company_id", "_key"], "left_anti").drop("_key")
        found = store.merge_existing(found, listed, finder.name, 0, as_of)
    found = written(found, "found")
    added, taken = _added(found, shared, stored)
    marks = found.select("company_id", "method", "method_ord")
    if shared is not None:
        added = added.unionByName(store.email_rows(shared.rows_without(taken)))
        found, marks = found.unionByName(shared.found()), marks.unionByName(_marks(shared))
    log = run_log(named, marks, [(0, finder)], track_policy)
    return BulkResult(
        found, added, store.update_methods(companies, log, as_of), reports.run_counts(found, added)
    )


@dataclass(frozen=True)
class WorkflowResult:
    found: DataFrame
    emails: DataFrame
    companies: DataFrame
    counters: DataFrame
    totals: DataFrame


def complete_workflow(
    companies: DataFrame,
    stored: DataFrame,
    registry: Registry,
    as_of: str,
    methods: list[str] | None = None,
    replies: DataFrame | None = None,
    track_policy: str = "workflow",
    checker: Checker = ReplyLogChecker(),
) -> WorkflowResult:
    """Find, store, track, check and count; the new snapshots are returned, not swapped in."""
    queue = dealt(companies)
    rows, shared = _find_parts(queue, registry.selected(methods), as_of)
    rows = written(rows, "found")
    added, taken = _added(rows, shared, stored)
    emails = schema.conform(stored, schema.EMAILS).select(*schema.EMAILS.fieldNames()).unionByName(added)
    keys = rows.select("company_id", store.storage_key(F.col("email")).alias("email"))
    found, marks, counted = rows, rows.select("company_id", "method", "method_ord"), reports.found_per_method(rows)
    if shared is not None:
        found, marks, counted = rows.unionByName(shared.found()), marks.unionByName(_marks(shared)), counted.unionByName(shared.counts())
    checked = keys.limit(0)
    if replies is not None:
        asked = keys
        if shared is not None and getattr(checker, "answers_replies", False):
            replied = replies.select("company_id", store.storage_key(F.col("email")).alias("email"))
            asked = keys.unionByName(shared.inside(replied).select(*store.EMAIL_KEY))
        elif shared is not None:
            asked = found.select("company_id", store.storage_key(F.col("email")).alias("email"))
        results = written(checker.check(asked.distinct(), replies), "results")
        good = results.filter(~F.col("is_error"))
        checked = keys.join(good, store.EMAIL_KEY, "left_semi")
        if shared is not None:
            # Rows with a result are made on their own; all others stay as they are.
            hit = shared.inside(results).join(taken.select(*store.EMAIL_KEY), store.EMAIL_KEY, "left_anti")
            emails = emails.unionByName(store.email_rows(shared.rows(hit)))
            taken = taken.unionByName(hit)
            often = F.explode(F.sequence(F.lit(1), F.col("copies")))
            checked = checked.unionByName(shared.inside(good).withColumn("copies", often).select(*store.EMAIL_KEY))
        emails = store.apply_check_results(emails, results, as_of, store.EMAIL_KEY)
    if shared is not None:
        emails = emails.unionByName(store.email_rows(shared.rows_without(taken)))
    log = run_log(queue, marks, registry.selected(methods), track_policy)
    wanted = registry.available() if methods is None else methods
    counters = reports.workflow_counters(companies, found, wanted, counted)
    return WorkflowResult(
        found,
        emails,
        store.update_methods(companies, log, as_of),
        counters,
        reports.workflow_totals(counters, checked),
    )
