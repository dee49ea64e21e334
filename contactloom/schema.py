"""Table layouts and schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "array<string>": T.ArrayType(T.StringType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _layout(text: str) -> T.StructType:
    """A layout from ``name type`` pairs, usable before a session exists."""
    pairs = [column.split(" ") for column in text.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


COMPANIES = _layout(
    "id bigint, name string, address string, phone string, website string, email string, "
    "search_query string, email_methods_used array<string>, email_methods_completed array<string>, "
    "last_email_scan timestamp_ntz"
)
COMPANY_INSERT = ["name", "address", "phone", "website", "email", "search_query"]

# Texts of stored rows and of the metric report.
STATIC_DETAILS = "Static pattern: "
SITE_DETAILS = "Website crawling with depth "
EXISTING_DETAILS = "Pre-existing email from database"
EXISTING_ORIGIN = {"origin": "database_column"}
UNNAMED_COMPANY = "Unknown Company"
COMPANY_METRICS = {"companies": "Total Companies", "with_website": "Companies with Websites"}
EMAIL_METRICS = {
    "emails": "Total Emails",
    "static": "Static Emails",
    "harvester": "Harvester Emails",
    "scraper": "Scraper Emails",
    "checked": "Checked Emails",
}

CHECK_FLAGS = [
    "mx_accepts_mail",
    "is_disposable",
    "is_role_account",
    "is_valid_syntax",
    "can_connect_smtp",
    "is_deliverable",
    "is_catch_all",
    "has_full_inbox",
    "is_disabled",
]
CHECK_RESULTS = ["is_reachable", "records", *CHECK_FLAGS]

EMAILS = _layout(
    "id bigint, company_id bigint, email string, source string, source_details string, confidence double, "
    "metadata string, created_at timestamp_ntz, is_reachable string, mx_accepts_mail boolean, records string, "
    "is_disposable boolean, is_role_account boolean, is_valid_syntax boolean, can_connect_smtp boolean, "
    "is_deliverable boolean, is_catch_all boolean, has_full_inbox boolean, is_disabled boolean, "
    "check_error string, checked_at timestamp_ntz"
)

FOUND = _layout(
    "company_id bigint, method string, method_ord int, seq bigint, email string, source string, "
    "source_details string, confidence double, metadata map<string,string>, found_at timestamp_ntz"
)


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Every column of the schema in order, missing ones as NULL, further ones kept at the end.

    A list stored as JSON text becomes a list; unreadable text becomes NULL.
    """
    present = {f.name: f.dataType for f in df.schema.fields}

    def value(field: T.StructField):
        if field.name not in present:
            return F.lit(None).cast(field.dataType)
        if isinstance(field.dataType, T.ArrayType) and isinstance(present[field.name], T.StringType):
            return F.from_json(field.name, field.dataType)
        return F.col(field.name).cast(field.dataType)

    extra = [c for c in df.columns if c not in schema.fieldNames()]
    return df.select(*[value(f).alias(f.name) for f in schema.fields], *extra)


def instant(as_of: str):
    """A fixed moment as a column; runs stay repeatable."""
    return F.lit(as_of).cast("timestamp_ntz")
