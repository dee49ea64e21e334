"""Addresses to check, handed out for a time: what is still open after it is handed out again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..operators.rank import capped_first, first_wins
from ..operators.store import EMAIL_KEY
from ..sources.keyed import KeyedTable
from ..sources.sinks import BUCKETS
from .jobs import run_available

OLDEST = ["attempts", "created_at", "id"]


class Leases:
    """The table of known addresses: open or checked, until when they are handed out, how often, and in which round."""

    LAYOUT = T.StructType(
        [
            *schema.EMAILS.fields,
            T.StructField("leased_until", T.TimestampNTZType()),
            T.StructField("attempts", T.IntegerType()),
            T.StructField("round", T.StringType()),
        ]
    )

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.table = KeyedTable(spark, path, self.LAYOUT, EMAIL_KEY, buckets)

    def arrive(self, emails: DataFrame, stream: str | None = None, batch: int = 0) -> None:
        """Takes in a snapshot or a part of one: new addresses, and the check of known ones.

        Of several rows of an address a checked one counts. A check is never taken back.
        """
        full = schema.conform(emails, schema.EMAILS).select(*schema.EMAILS.fieldNames())
        one = first_wins(full, EMAIL_KEY, [F.col("checked_at").isNull(), F.col("created_at"), F.col("id")])
        rows = one.withColumns(
            {"leased_until": F.lit(None).cast("timestamp_ntz"), "attempts": F.lit(0), "round": F.lit(None).cast("string")}
        )
        results = [*schema.CHECK_RESULTS, "check_error", "checked_at"]
        checked = one.filter(F.col("checked_at").isNotNull()).select(*EMAIL_KEY, F.struct(*results).alias("_check"))

        def closed(stored: DataFrame) -> DataFrame:
            """Only rows that a check changes are written again."""
            met = stored.join(checked, EMAIL_KEY).filter(~F.struct(*results).eqNullSafe(F.col("_check")))
            return met.select(*[F.col("_check")[c].alias(c) if c in results else c for c in self.LAYOUT.fieldNames()])

        self.table.put(rows, closed, stream, batch)

    def hand_out(self, now: str, seconds: int, limit: int | None = None, name: str | None = None, batch: int = 0) -> DataFrame:
        """Open addresses that no one has, those handed out least often and oldest first; they are leased from now on.

        Two that ask at the same time never get the same address. A round of a
        name that was given before gives the same addresses again, so a replayed
        batch loses none.
        """
        spark, moment = self.table.spark, schema.instant(now)
        tag = f"{name}:{batch}"
        if name is not None and self.table.state().done.get(name, -1) >= batch:
            return self.table.rows().filter(F.col("round") == tag)

        def is_due() -> F.Column:
            return F.col("checked_at").isNull() & (F.col("leased_until").isNull() | (F.col("leased_until") <= moment))

        due = self.table.rows().filter(is_due())
        picked = capped_first(due, [F.col(c) for c in OLDEST], limit) if limit else due
        until = F.timestamp_add("SECOND", F.lit(seconds), moment)

        def leased(stored: DataFrame) -> DataFrame:
            changes = {"leased_until": until, "attempts": F.col("attempts") + 1, "round": F.lit(tag if name is not None else None).cast("string")}
            return stored.filter(is_due()).withColumns(changes).select(*self.LAYOUT.fieldNames())

        return self.table.update(picked.select(*EMAIL_KEY), leased, name, batch)


def poll_with_leases(
    emails: DataFrame,
    path: str,
    checkpoint: str,
    now: Callable[[], str],
    seconds: int,
    each: Callable[[DataFrame, int], None],
    limit: int | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Every arriving batch is taken in, then what is due is given to ``each``."""
    leases = Leases(emails.sparkSession, path, buckets)

    def run(batch: DataFrame, n: int) -> None:
        leases.arrive(batch, f"{checkpoint}#arrivals", n)
        each(leases.hand_out(now(), seconds, limit, f"{checkpoint}#rounds", n), n)

    return run_available(emails, checkpoint, run)
