"""Report figures that are carried forward: a day's rows are added, the table is not read again.

A state is a small table: for each day and source the counts of the metric
report, and sketches of the domains and companies met. States of disjoint rows
merge by sums and sketch unions, in any order and grouping, so a report over
years is a sum over days. Counts are exact; numbers of distinct values are those of the sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import _domain_part

KEY = ["day", "source"]
COUNTS = ["n_emails", "n_checked", "n_reachable", "n_errors"]
SKETCHES = {"domains": "n_domains", "companies": "n_companies"}
# Size of a sketch: 2 ** 12 registers, about 1.6 % off.
SKETCH_BITS = 12


def _count(condition: Column | None = None) -> Column:
    return F.count(F.lit(1)) if condition is None else F.count_if(condition)


def email_state(emails: DataFrame) -> DataFrame:
    """The state of new rows of the address table, by the day they were created."""
    day = F.col("created_at").cast("date")
    return emails.groupBy(day.alias("day"), "source").agg(
        _count().alias("n_emails"),
        *_checks(1),
        F.hll_sketch_agg(_domain_part(F.col("email")), F.lit(SKETCH_BITS)).alias("domains"),
        F.hll_sketch_agg(F.col("company_id"), F.lit(SKETCH_BITS)).alias("companies"),
    )


def _checks(sign: int) -> list[Column]:
    tests = {
        "n_checked": F.col("checked_at").isNotNull(),
        "n_reachable": F.coalesce(F.col("is_reachable") == "safe", F.lit(False)),
        "n_errors": F.col("check_error").isNotNull(),
    }
    return [(sign * _count(test)).cast("long").alias(name) for name, test in tests.items()]


def change_state(before: DataFrame, after: DataFrame) -> DataFrame:
    """The state to add for rows that were changed: what they count now, less what they counted before.

    No address comes or goes, so its sketches are empty of change; only the counts of checks move.
    """
    day = F.col("created_at").cast("date").alias("day")
    none = [F.lit(None).cast("binary").alias(c) for c in SKETCHES]
    parts = [
        rows.groupBy(day, "source").agg(*_checks(sign)).withColumn("n_emails", F.lit(0).cast("long"))
        for rows, sign in ((before, -1), (after, 1))
    ]
    return parts[0].unionByName(parts[1]).select(*KEY, *COUNTS, *none)


def merged(*states: DataFrame) -> DataFrame:
    """One state of many: a row per day and source."""
    every = states[0].select(*KEY, *COUNTS, *SKETCHES)
    for state in states[1:]:
        every = every.unionByName(state.select(*KEY, *COUNTS, *SKETCHES))
    return every.groupBy(*KEY).agg(
        *[F.sum(c).alias(c) for c in COUNTS], *[F.hll_union_agg(F.col(c)).alias(c) for c in SKETCHES]
    )


def report(state: DataFrame, *by: str) -> DataFrame:
    """Counts, and estimates of distinct domains and companies, over all days or by ``day`` or ``source``."""
    sums = [F.sum(c).alias(c) for c in COUNTS]
    distinct = [F.hll_sketch_estimate(F.hll_union_agg(F.col(c))).alias(n) for c, n in SKETCHES.items()]
    return state.groupBy(*by).agg(*sums, *distinct)
