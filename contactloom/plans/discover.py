"""From search plan and collected listings to new company rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..operators.listing import accepted_per_query, company_record, listing_name


def discover(
    listings: DataFrame, details: DataFrame, stored: DataFrame, per_query: int, arrival: list[str]
) -> DataFrame:
    """Rows to append to the companies.

    ``listings`` holds (id, search_query, label, href, child) and the arrival
    columns, ``details`` the raw fields of the opened listing by id. Listings
    without a usable name or known under the query are dropped before the cap
    is counted, and only the accepted ones meet their details.
    """
    name = listing_name(F.col("label"), F.col("href"), F.col("child"))
    named = listings.withColumn("name", name).select("id", "search_query", "name", *arrival)
    accepted = accepted_per_query(named, stored, per_query, arrival)
    fields = details.drop("search_query").withColumnRenamed("name", "_detail")
    opened = accepted.select("id", "search_query", F.col("name").alias("_listed")).join(fields, "id", "left")
    # A detail page without a name of its own keeps the listed one, and so does a
    # listing whose details failed; its other fields are missing values.
    raw = opened.withColumn("name", F.coalesce("_detail", "_listed")).drop("_detail", "_listed")
    return company_record(raw).select(*schema.COMPANY_INSERT)
