"""Applying collected validator replies to the address table."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import storage_key
from ..operators import checks, queues, store
from ..operators.rank import batches, first_wins
from ..session import written


class Checker(Protocol):
    name: str

    def check(self, emails: DataFrame, replies: DataFrame) -> DataFrame:
        """One flat result row per answered address: key, result columns, check_error, is_error."""


@dataclass(frozen=True)
class ReplyLogChecker:
    """Reads the replies an external fetcher stored; the first in ``order`` counts."""

    name: str = "checker"
    order: tuple[str, ...] = ()
    failure: Column | None = None
    # Addresses without a reply get no result, so they need not be asked.
    answers_replies: bool = True

    def check(self, emails: DataFrame, replies: DataFrame) -> DataFrame:
        keyed = replies.withColumn("email", storage_key(F.col("email")))
        # Only replies to asked addresses are ranked, so the rest of the log isn't sorted.
        asked = keyed.join(emails.select(*store.EMAIL_KEY), store.EMAIL_KEY, "left_semi")
        # Without an order of arrival a reply with content goes before an empty one.
        empty = F.coalesce(F.length("reply"), F.lit(0)) == 0
        single = first_wins(asked, store.EMAIL_KEY, list(self.order) or [empty, "reply"])
        return checks.flatten_replies(single, failure=self.failure)


@dataclass(frozen=True)
class NoChecker:
    """Every address answers with an error."""

    name: str = "none"

    def check(self, emails: DataFrame, replies: DataFrame | None = None) -> DataFrame:
        none = [F.lit(None).cast(schema.EMAILS[c].dataType).alias(c) for c in schema.CHECK_RESULTS]
        return emails.select(
            *store.EMAIL_KEY, *none, F.lit("no_checker_available").alias("check_error"), F.lit(True).alias("is_error")
        )


def checked_snapshot(
    emails: DataFrame, replies: DataFrame, as_of: str, checker: Checker = ReplyLogChecker(), queue: DataFrame | None = None
) -> DataFrame:
    """Addresses with the results of the answered ones applied, by natural key."""
    results = checker.check(emails if queue is None else queue, replies)
    return store.apply_check_results(emails, results, as_of, store.EMAIL_KEY)


def check_pipeline(
    emails: DataFrame,
    replies: DataFrame,
    as_of: str,
    limit: int | None = None,
    source: str | None = None,
    max_requests: int | None = None,
    checker: Checker = ReplyLogChecker(),
) -> DataFrame:
    """Queue, budget, replies, new snapshot."""
    bounds = [n for n in (limit, max_requests) if n]
    # Order matters only where a bound cuts the queue.
    queue = queues.unchecked(emails, min(bounds), source) if bounds else queues.never_checked(emails, source)
    return checked_snapshot(emails, replies, as_of, checker, queue)


@dataclass(frozen=True)
class CheckRun:
    """The new snapshot, and a row for each batch: batch_no, n_queued, n_answered, n_errors."""

    snapshot: DataFrame
    batches: DataFrame


def check_run(
    emails: DataFrame,
    replies: DataFrame,
    as_of: str,
    batch_size: int,
    limit: int | None = None,
    source: str | None = None,
    max_requests: int | None = None,
    checker: Checker = ReplyLogChecker(),
) -> CheckRun:
    """``check_pipeline`` over a queue dealt into batches, oldest addresses first.

    Batches are numbers, not jobs: all are answered in one join, whatever their
    size. A batch whose addresses all failed shows in its row. The numbered queue and the results
    are written once, since snapshot and report read both.
    """
    bounds = [n for n in (limit, max_requests) if n]
    queue = queues.unchecked(emails, min(bounds), source) if bounds else queues.never_checked(emails, source)
    numbered = written(batches(queue, ["created_at", "id"], batch_size), "check-queue")
    results = written(checker.check(numbered.drop("batch_no"), replies), "check-results")
    met = numbered.select(*store.EMAIL_KEY, "batch_no").join(results.select(*store.EMAIL_KEY, "is_error"), store.EMAIL_KEY, "left")
    report = met.groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("n_queued"),
        F.count("is_error").alias("n_answered"),
        F.count_if(F.col("is_error")).alias("n_errors"),
    )
    return CheckRun(store.apply_check_results(emails, results, as_of, store.EMAIL_KEY), report)


def n_checked(snapshot: DataFrame, as_of: str) -> DataFrame:
    """Number of addresses a run marked as checked."""
    return snapshot.agg(F.count_if(F.col("checked_at") == schema.instant(as_of)).alias("n_checked"))
