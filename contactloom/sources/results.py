"""Addresses from result files of other tools and from list columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.emails import basic_tokens, is_email_basic, split_existing
from ..functions.chars import SPACE
from ..functions.text import storage_key, strip

# A JSON string, quotes excluded; possessive, so long strings cannot overflow.
JSON_STRING = r'"((?:[^"\\]++|\\.)*+)"'
# Numbers that writers of JSON use though JSON has none of them.
NO_NUMBER = r"-?\b(?:NaN|Infinity)\b"
# A string that starts with a mark allowed in addresses.
MARKED = rf"(?m)^[{SPACE}]*[.%+\-][a-zA-Z0-9._%+\-]*@"


def read_result_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per result file: (path, body)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def all_strings(body: Column) -> Column:
    """Every string of a JSON document, keys included, decoded, one per line.

    A line break never belongs to an address, so neighbours stay apart.
    """
    raw = F.regexp_extract_all(body, F.lit(JSON_STRING), F.lit(0))
    decoded = F.from_json(F.concat(F.lit("["), F.array_join(raw, ","), F.lit("]")), "array<string>")
    return F.array_join(decoded, "\n")


def readable(body: Column, document: Column) -> Column:
    """Whether a document counts as JSON.

    The variant parser also refuses repeated keys, very large documents and the
    numbers NaN and Infinity; an object whose keys can be listed to its end, and
    a list of any size whose items can be counted, is read all the same, by its strings.
    Only documents the variant parser refuses are looked at again. What has text
    behind the document is none.
    """
    bare = F.regexp_replace(F.regexp_replace(body, JSON_STRING, '""'), NO_NUMBER, "0")
    listed = F.json_object_keys(bare).isNotNull() & F.rtrim(F.right(body, F.lit(64))).endswith("}")
    counted = F.json_array_length(bare).isNotNull() & F.rtrim(F.right(body, F.lit(64))).endswith("]")
    return (document.isNotNull() & nothing_behind(body)) | F.coalesce(listed, F.lit(False)) | F.coalesce(counted, F.lit(False))


def nothing_behind(body: Column) -> Column:
    """Whether a document the variant parser reads is all there is: as the only item of a list it makes a list of one.

    An item with text behind it, or a second document, breaks the list.
    """
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1, F.lit(False))


def rejected_results(results: DataFrame, body: str = "body") -> DataFrame:
    """The documents that give nothing because they are no JSON, for a count or a closer look."""
    return results.filter(~readable(F.col(body), F.try_parse_json(body)))


def result_emails(document: Column, strings: Column, usable: Column | None = None) -> Column:
    """Addresses in the known fields and in any string of a JSON document.

    The search runs over decoded strings, so escapes do not leak into
    addresses. A document that is not ``usable`` (by default one the variant
    parser can't read) gives an empty list.
    """
    none = F.array().cast("array<string>")
    fields = F.flatten(F.array(*[_field(document, name) for name in ("emails", "email", "people")]))
    # The token search finds every whole address but those that start with a
    # mark, where it finds the rest only; so the fields are rarely looked at.
    whole = F.when(
        strings.rlike(MARKED), F.filter(F.transform(fields, storage_key), is_email_basic)
    ).otherwise(none)
    return F.when(document.isNull() if usable is None else ~usable, none).otherwise(
        F.array_distinct(F.concat(F.coalesce(whole, none), F.coalesce(basic_tokens(strings), none)))
    )


def _field(document: Column, name: str) -> Column:
    """Strings of a field: a list of strings or of objects with ``email``, or one string."""
    items = F.coalesce(
        F.try_variant_get(document, f"$.{name}", "array<variant>"), F.array().cast("array<variant>")
    )
    texts = F.transform(items, lambda v: F.try_variant_get(v, "$", "string"))
    nested = F.transform(items, lambda v: F.try_variant_get(v, "$.email", "string"))
    single = F.array(F.try_variant_get(document, f"$.{name}", "string"))
    return F.concat(texts, nested, single)


def emails_from_results(results: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Distinct (keys, email) of many result documents."""
    # A document without an @, escaped or not, has nothing to find.
    hopeful = results.filter(F.contains(body, F.lit("@")) | F.contains(body, F.lit("\\u0040")))
    # Parsing and decoding are steps of their own, done once per row. The list is
    # exploded as an expression: a named column would be worked out again in the
    # filter Spark derives from it.
    read = hopeful.withColumn("_document", F.try_parse_json(body))
    parsed = read.select(
        *keys,
        "_document",
        all_strings(F.col(body)).alias("_strings"),
        readable(F.col(body), F.col("_document")).alias("_usable"),
    )
    found = result_emails(F.col("_document"), F.col("_strings"), F.col("_usable"))
    return parsed.select(*keys, F.explode(found).alias("email")).distinct()


def emails_from_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Distinct lower-case addresses, one candidate per line."""
    value = strip(F.col(line))
    return lines.filter(is_email_basic(F.col(line))).select(F.lower(value).alias("email")).distinct()


def existing_emails(companies: DataFrame, column: str = "existing", id_column: str = "id") -> DataFrame:
    """One row per listed address, repeats kept, with its place in the list."""
    listed = F.posexplode(split_existing(F.col(column))).alias("place", "email")
    return companies.select(F.col(id_column).alias("company_id"), listed)
