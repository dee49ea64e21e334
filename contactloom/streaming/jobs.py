"""Structured Streaming jobs over arriving files.

The stored table, not stream state, decides what is new, so a repeat is ignored
for ever and state does not grow. A micro-batch is committed with the name of
its stream, which is the checkpoint, and its number: replayed after a failure it
adds nothing, and two streams into one table never store an address twice. Only
the parts of the table that may hold a batch's keys are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..operators.finders import StaticFinder
from ..operators.listing import guess_email
from ..functions.domains import domain_naive
from ..functions.text import clean_email
from ..sources.sinks import BUCKETS, email_table, insert_found
from ..operators.queues import has_real_website


def file_stream(
    spark: SparkSession, path: str, layout, pattern: str | None = None, most_files: int | None = None, most_bytes: str | None = None
) -> DataFrame:
    """Parquet files arriving in a folder; a micro-batch takes all there are, or the given files or bytes at most."""
    reader = spark.readStream.schema(layout)
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    if most_bytes:
        reader = reader.option("maxBytesPerTrigger", most_bytes)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Work off what is there and stop; the checkpoint resumes the next run."""
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def dedupe_into(
    found: DataFrame, store_path: str, checkpoint: str, order: list[str], buckets: int = BUCKETS
) -> StreamingQuery:
    """Found addresses into the store; (company, address) pairs stored before are ignored."""
    table = email_table(found.sparkSession, store_path, buckets)

    def each(batch: DataFrame, n: int) -> None:
        insert_found(table, batch, order, checkpoint, n)

    return run_available(found, checkpoint, each)


def dedupe_within(found: DataFrame, event_time: str, delay: str) -> DataFrame:
    """State-bounded alternative: forgets pairs older than the delay."""
    return found.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["company_id", "email"])


def enrich_into(
    companies: DataFrame,
    store_path: str,
    checkpoint: str,
    as_of: str,
    inline: bool = True,
    finder: StaticFinder = StaticFinder(),
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Each arriving company gets its role addresses stored, or a single guess when not inline."""
    table = email_table(companies.sparkSession, store_path, buckets)

    def each(batch: DataFrame, n: int) -> None:
        if inline:
            rows = finder.find(batch, as_of)
        else:
            guess = clean_email(guess_email(domain_naive(F.col("website"))))
            rows = (
                batch.filter(has_real_website(F.col("website")))
                .select(
                    F.col("id").alias("company_id"),
                    F.lit("static").alias("method"),
                    F.lit(0).alias("method_ord"),
                    F.lit(0).cast("long").alias("seq"),
                    guess.alias("email"),
                    F.lit("static").alias("source"),
                    F.lit("Address guess").alias("source_details"),
                    F.lit(0.95).alias("confidence"),
                    F.lit(None).cast("map<string,string>").alias("metadata"),
                    schema.instant(as_of).alias("found_at"),
                )
                .filter(F.col("email") != "N/A")
            )
        insert_found(table, rows, ["method_ord", "seq"], checkpoint, n)

    return run_available(companies, checkpoint, each)


def poll_into(
    emails: DataFrame, seen_path: str, checkpoint: str, buckets: int = BUCKETS
) -> StreamingQuery:
    """Unchecked addresses of arriving snapshots, each handed out once. ``leases`` hands out again what stays open."""
    table = email_table(emails.sparkSession, seen_path, buckets)

    def each(batch: DataFrame, n: int) -> None:
        open_ = batch.filter(F.col("checked_at").isNull())
        insert_found(table, open_, ["created_at", "id"], checkpoint, n)

    return run_available(emails, checkpoint, each)


def store_contents(spark: SparkSession, path: str) -> DataFrame:
    return email_table(spark, path).rows()
