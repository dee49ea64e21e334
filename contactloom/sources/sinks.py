"""Append-only company and address tables on Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.store import EMAIL_KEY, apply_check_results, dedupe_first, email_rows, not_stored, update_methods
from ..session import written
from .keyed import KeyedTable

# Buckets of a new keyed table: each should hold some hundred MB in the end.
BUCKETS = 16


def append_companies(df: DataFrame, path: str) -> None:
    """Six columns, repeats allowed."""
    df.select(*schema.COMPANY_INSERT).write.mode("append").parquet(path)


def read_table(spark: SparkSession, path: str, layout) -> DataFrame:
    """The table, or an empty one before the first write; new columns read as NULL."""
    try:
        return spark.read.schema(layout).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return schema.empty_table(spark, layout)


def insert_new_emails(found: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Append addresses not stored yet; returns what was added.

    The rows are written apart first: the store is never read and changed in
    one job, and a retried stage cannot add a row twice.
    """
    spark = found.sparkSession
    stored = read_table(spark, path, schema.EMAILS)
    batch = written(email_rows(dedupe_first(found, order)), "batch-emails")
    added = written(not_stored(batch, batch.count(), stored), "added-emails")
    added.write.mode("append").parquet(path)
    return added


def save_bucketed(emails: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """A snapshot bucketed by the address key, so merges and checks need not shuffle it."""
    writer = emails.write.bucketBy(buckets, *EMAIL_KEY).sortBy(*EMAIL_KEY).option("path", path)
    writer.mode("overwrite").saveAsTable(table)
    return emails.sparkSession.table(table)


def email_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedTable:
    """Addresses by (company, address): small batches and updates neither read nor write the rest."""
    return KeyedTable(spark, path, schema.EMAILS, EMAIL_KEY, buckets)


def company_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedTable:
    return KeyedTable(spark, path, schema.COMPANIES, ["id"], buckets)


def insert_found(table: KeyedTable, found: DataFrame, order: list[str], stream: str | None = None, batch: int = 0) -> DataFrame:
    """Insert-or-ignore of found addresses; returns what was added. A batch of a stream is taken once."""
    return table.insert(email_rows(dedupe_first(found, order)), stream, batch)


def save_check_results(
    table: KeyedTable, results: DataFrame, as_of: str, stream: str | None = None, batch: int = 0
) -> DataFrame:
    """Check results into the stored addresses they belong to, by natural key; returns the changed rows."""
    return table.update(results, lambda rows: apply_check_results(rows, results, as_of, EMAIL_KEY), stream, batch)


def save_method_runs(table: KeyedTable, runs: DataFrame, as_of: str, stream: str | None = None, batch: int = 0) -> DataFrame:
    """A log of method runs into the companies it names; returns the changed rows."""
    keys = runs.select(F.col("company_id").alias("id"))
    return table.update(keys, lambda rows: update_methods(rows, runs, as_of), stream, batch)
