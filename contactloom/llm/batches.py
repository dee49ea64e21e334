"""Arrow batches of texts, cut by bytes so that long texts don't pile up in a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each with about ``most`` bytes of text, or one longer text."""
    start, held = 0, 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow form of a DDL schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def aside(df: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all columns but ``own`` under names of no meaning, and the way back, which leaves other columns as they are.

    So no column of a table can clash with one that an operator needs for itself.
    """
    names = {c if c in own else f"_aside{i}": c for i, c in enumerate(df.columns)}

    def back(done: DataFrame) -> DataFrame:
        return done.toDF(*[names.get(c, c) for c in done.columns])

    return df.toDF(*names), back


def one_column(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; fails early where one is missing or named twice."""
    for name in names:
        if df.columns.count(name) != 1:
            raise ValueError(f"one column named {name} is needed, found {df.columns.count(name)} in {df.columns}")
    return df.select(*names)
