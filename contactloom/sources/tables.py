"""Company and page scans, lookups and the search plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.queues import method_list
from ..operators.skew import salted_join

DEFAULT_COLUMNS = {"id": "id", "name": "name", "website": "website"}


def map_companies(df: DataFrame, columns: Mapping[str, str] = DEFAULT_COLUMNS, tracking: bool = False) -> DataFrame:
    """Any company table under standard names; ``existing`` is optional.

    With ``tracking`` the method lists and the time of the last scan come
    along, as a bulk run needs them: lists kept as JSON text are read, columns
    the table lacks are empty.
    """
    names = [n for n in ("id", "name", "website", "existing") if columns.get(n)]
    mapped = [F.col(columns[n]).alias(n) for n in names]
    if not tracking:
        return df.select(*mapped)

    def methods(name: str) -> Column:
        if not columns.get(name):
            return F.array().cast("array<string>").alias(name)
        stored = F.col(columns[name])
        is_text = isinstance(df.select(stored).schema[0].dataType, T.StringType)
        return (method_list(stored) if is_text else stored).alias(name)

    scan = columns.get("last_email_scan")
    last = (F.col(scan) if scan else F.lit(None)).cast("timestamp_ntz").alias("last_email_scan")
    return df.select(*mapped, methods("email_methods_used"), methods("email_methods_completed"), last)


def by_id(df: DataFrame, key: int, id_column: str = "id") -> DataFrame:
    """Zero or one row; the equality reaches the file scan."""
    return df.filter(F.col(id_column) == F.lit(key))


def pages(df: DataFrame) -> DataFrame:
    """Archived pages in place of live fetches."""
    return df.select("page_id", "url", "html")


def config_list(text: str) -> list[str]:
    """A settings list, split on a comma and one blank."""
    return text.split(", ")


def expand_queries(
    templates: DataFrame, countries: list[str] | DataFrame, states: list[str] | DataFrame, column: str = "template"
) -> DataFrame:
    """One query per country or state named in a template, or the template itself.

    A template with both placeholders keeps ``${state}``. Countries and states
    are two lists, which become constants of the plan, or two tables of any
    size, whose first column is joined.
    """
    if isinstance(countries, DataFrame) and isinstance(states, DataFrame):
        return _expanded_by_tables(templates, countries, states, column)
    text = F.col(column)
    by_country = F.contains(text, F.lit("${country}"))
    by_state = F.contains(text, F.lit("${state}"))

    def filled(placeholder: str, values: list[str]):
        items = F.array(*[F.lit(v) for v in values]).cast("array<string>")
        return F.transform(items, lambda v: F.replace(text, F.lit(placeholder), v))

    queries = (
        F.when(by_country, filled("${country}", countries))
        .when(by_state, filled("${state}", states))
        .otherwise(F.array(text))
    )
    return templates.withColumn("query", F.explode(queries))


def _expanded_by_tables(templates: DataFrame, countries: DataFrame, states: DataFrame, column: str) -> DataFrame:
    text = F.col(column)
    kinds = {"${country}": countries, "${state}": states}
    kind = F.when(F.contains(text, F.lit("${country}")), "${country}").when(F.contains(text, F.lit("${state}")), "${state}")
    placed = templates.withColumn("_kind", kind)
    first, second = (
        table.select(F.lit(k).alias("_kind"), F.col(table.columns[0]).cast("string").alias("_value")) for k, table in kinds.items()
    )
    # Two keys hold all values, so both are hot.
    met = salted_join(first.unionByName(second), placed, "_kind", "inner", F.col("_value"), list(kinds))
    filled = met.select(*templates.columns, F.replace(text, F.col("_kind"), F.col("_value")).alias("query"))
    return filled.unionByName(placed.filter("_kind is null").select(*templates.columns, text.alias("query")))


def settings_values(df: DataFrame, column: str, most: int = 1000) -> list[str]:
    """A settings-sized table as a list; a larger one is refused, not cut."""
    rows = df.select(column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column}: more than {most} values; join the table instead")
    return sorted(r[0] for r in rows)
