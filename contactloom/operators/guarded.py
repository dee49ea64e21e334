"""Users' own Python functions, run so that a bad row costs that row only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schema
from ..session import written
from .skew import dealt

# Rows handed to a user's function at once; characters of an error that are kept.
BATCH_ROWS, ERROR_CHARS = 1000, 500
# Rows of a task that calls a user's function.
CALL_ROWS = 10_000


@dataclass(frozen=True)
class Guarded:
    """What a function gave, and a row (key columns, error) for each input row it failed on."""

    rows: DataFrame
    errors: DataFrame


def guarded(rows: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], layout, key: list[str], batch_rows: int = BATCH_ROWS) -> Guarded:
    """``fn`` over batches of ``rows``; its result has the columns of ``layout``.

    A batch on which ``fn`` raises, or gives something else than ``layout``, is
    halved until single rows are left; those become errors, all others keep
    their results. ``fn`` may so see a row several times. Rows are dealt into
    tasks of CALL_ROWS first, since a table of one row group would be one task. The outcome is
    written once, so that results and errors come from the same calls.
    """
    fields = [rows.schema[c] for c in key]
    out_type = schema.T.StructType(
        [*layout.fields, schema.T.StructField("_key", schema.T.StructType(fields)), schema.T.StructField("_error", schema.T.StringType())]
    )
    out = to_arrow_schema(out_type)
    names = [f.name for f in layout.fields]

    def result(frame: pd.DataFrame) -> pa.RecordBatch:
        given = fn(frame)
        n = len(given)
        columns = [pa.array(given[c].astype(object).to_list(), out.field(c).type, from_pandas=True) for c in names]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(n, out.field("_key").type), pa.nulls(n, pa.string())], schema=out)

    def attempt(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        try:
            yield result(batch.to_pandas())
        except Exception as e:  # whatever a user's function does
            n = batch.num_rows
            if n > 1:
                yield from attempt(batch.slice(0, n // 2))
                yield from attempt(batch.slice(n // 2))
                return
            text = f"{type(e).__name__}: {e}"[:ERROR_CHARS]
            empty = [pa.nulls(1, out.field(c).type) for c in names]
            keys = pa.array([{c: batch.column(c)[0].as_py() for c in key}], out.field("_key").type)
            yield pa.RecordBatch.from_arrays([*empty, keys, pa.array([text])], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                yield from attempt(batch.slice(start, batch_rows))

    done = written(dealt(rows, CALL_ROWS).mapInArrow(run, out_type), "guarded")
    good = done.filter(F.col("_error").isNull()).select(*names)
    return Guarded(good, done.filter(F.col("_error").isNotNull()).select("_key.*", F.col("_error").alias("error")))


class GuardedFinder:
    """A finder made of a function from companies (a pandas frame) to rows (company_id, email, confidence).

    A company on which the function raises gives no rows, counts as failed, and
    is found in ``errors``; all others are served.
    """

    def __init__(self, name: str, fn: Callable[[pd.DataFrame], pd.DataFrame], enabled: bool = True, priority: int = 100):
        self.name, self.fn, self.enabled, self.priority = name, fn, enabled, priority
        self._last: tuple[DataFrame, Guarded] | None = None

    def _run(self, companies: DataFrame) -> Guarded:
        """One run for the rows, the attempts and the errors of one set of companies."""
        if self._last is None or not self._last[0].sameSemantics(companies):
            layout = schema.T.StructType([schema.FOUND[c] for c in ("company_id", "email", "confidence")])
            self._last = companies, guarded(companies, self.fn, layout, ["id"])
        return self._last[1]

    def find(self, companies: DataFrame, as_of: str, method_ord: int) -> DataFrame:
        rows = self._run(companies).rows
        return rows.select(
            "company_id",
            F.lit(self.name).alias("method"),
            F.lit(method_ord).alias("method_ord"),
            F.lit(0).cast("long").alias("seq"),
            "email",
            F.lit(self.name).alias("source"),
            F.lit(self.name).alias("source_details"),
            "confidence",
            F.lit(None).cast("map<string,string>").alias("metadata"),
            schema.instant(as_of).alias("found_at"),
        )

    def errors(self, companies: DataFrame) -> DataFrame:
        return self._run(companies).errors.select(F.col("id").alias("company_id"), "error")

    def attempts(self, companies: DataFrame) -> DataFrame:
        failed = self.errors(companies).select("company_id").distinct().withColumn("_failed", F.lit(True))
        rows = companies.select(F.col("id").alias("company_id"), F.lit(True).alias("valid")).join(failed, "company_id", "left")
        return rows.select("company_id", "valid", F.col("_failed").isNull().alias("succeeded"))


class GuardedChecker:
    """A checker made of a function from (address, its reply) rows to check results.

    ``fn`` gets a pandas frame with the address key and ``reply``, and gives the
    key with the result columns it knows of. A row on which it raises becomes a
    result with the error, so the address counts as checked with an error.
    """

    def __init__(self, name: str, fn: Callable[[pd.DataFrame], pd.DataFrame], key: tuple[str, ...] = ("company_id", "email")):
        self.name, self.fn, self.key = name, fn, list(key)

    def check(self, emails: DataFrame, replies: DataFrame) -> DataFrame:
        results = [*self.key, *schema.CHECK_RESULTS]
        layout = schema.T.StructType([schema.EMAILS[c] for c in results])
        given = emails.select(*self.key).join(replies.select(*self.key, "reply"), self.key)
        fn = self.fn

        def full(frame: pd.DataFrame) -> pd.DataFrame:
            return fn(frame).reindex(columns=results)

        done = guarded(given, full, layout, self.key)
        none = [F.lit(None).cast(schema.EMAILS[c].dataType).alias(c) for c in schema.CHECK_RESULTS]
        good = done.rows.select(*results, F.lit(None).cast("string").alias("check_error"), F.lit(False).alias("is_error"))
        return good.unionByName(done.errors.select(*self.key, *none, F.col("error").alias("check_error"), F.lit(True).alias("is_error")))
