"""Mailbox-validation replies collected elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.emails import json_items
from ..sources.results import nothing_behind

REPLY = (
    "is_reachable string, mx struct<accepts_mail boolean, records array<string>>, "
    "misc struct<is_disposable boolean, is_role_account boolean>, syntax struct<is_valid_syntax boolean>, "
    "smtp struct<can_connect_smtp boolean, is_deliverable boolean, is_catch_all boolean, "
    "has_full_inbox boolean, is_disabled boolean>"
)
PLACES = {
    "is_reachable": "is_reachable",
    "mx_accepts_mail": "mx.accepts_mail",
    "is_disposable": "misc.is_disposable",
    "is_role_account": "misc.is_role_account",
    "is_valid_syntax": "syntax.is_valid_syntax",
    "can_connect_smtp": "smtp.can_connect_smtp",
    "is_deliverable": "smtp.is_deliverable",
    "is_catch_all": "smtp.is_catch_all",
    "has_full_inbox": "smtp.has_full_inbox",
    "is_disabled": "smtp.is_disabled",
}


def _has_key(document: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(document), key), F.lit(False))


def reply_problem(reply: Column) -> Column:
    """(is_error, code) of a reply text; the key ``error`` counts even when null. What has text behind the object can't be decoded."""
    keys = F.when(nothing_behind(reply), F.json_object_keys(reply))
    empty = reply.isNull() | reply.rlike(r"^\s*(?:null|\{\s*\}|\[\s*\]|)\s*$")
    code = (
        F.when(empty, F.lit("no_response"))
        .when(keys.isNull(), F.lit("json_decode_error"))
        .when(_has_key(reply, "error"), F.get_json_object(reply, "$.error"))
    )
    failed = empty | keys.isNull() | _has_key(reply, "error")
    return F.struct(failed.alias("is_error"), code.alias("code"))


def flatten_replies(replies: DataFrame, reply: str = "reply", failure: Column | None = None) -> DataFrame:
    """Flat result columns, or only ``check_error``.

    ``failure`` is an optional code of a fetch that gave no reply at all.
    """
    text = F.col(reply)
    problem = reply_problem(text)
    parsed = replies.withColumn("_problem", problem).withColumn("_reply", F.from_json(text, REPLY))
    if failure is not None:
        known = F.struct(F.lit(True).alias("is_error"), failure.alias("code"))
        parsed = parsed.withColumn("_problem", F.when(failure.isNotNull(), known).otherwise(F.col("_problem")))
    good = ~F.col("_problem.is_error")
    listed = F.concat(F.lit("["), json_items(F.col("_reply.mx.records")), F.lit("]"))
    absent = F.when(_has_key(F.get_json_object(text, "$.mx"), "records"), F.lit("null")).otherwise(F.lit("[]"))
    values = {c: F.col(f"_reply.{place}") for c, place in PLACES.items()}
    values["records"] = F.coalesce(listed, absent)
    return parsed.select(
        *[c for c in replies.columns if c not in (*schema.CHECK_RESULTS, "check_error")],
        *[F.when(good, values[c]).alias(c) for c in schema.CHECK_RESULTS],
        F.col("_problem.code").alias("check_error"),
        F.col("_problem.is_error").alias("is_error"),
    )


def failure_code(outcome: Column, status: Column, detail: Column) -> Column:
    """Code of a failed fetch; NULL when it went well."""
    return (
        F.when(outcome == "ok", F.lit(None).cast("string"))
        .when(outcome == "http_error", F.concat(F.lit("http_error_"), status.cast("string")))
        .when(outcome.isin("timeout", "connection_error", "request_exception", "json_decode_error"), outcome)
        .otherwise(F.concat(F.lit("exception_"), detail))
    )
