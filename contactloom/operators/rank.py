"""First-wins, top-n per group and exact numbering without single-task groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

# Spark trims every group to its first rows before the shuffle when a rank is
# compared with a value up to this size (its window group limit).
GROUP_LIMIT = 1000
# A page that ends within so many rows is sorted in one task.
PAGE_ROWS = 10_000


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The earliest row of each key.

    The ``== 1`` test lets Spark keep one row per key and input task before the
    shuffle, so a key holding a third of all rows arrives as a few rows.
    """
    return top_n_per_group(df, keys, order, 1)


def top_n_per_group(
    df: DataFrame, keys: list[str], order: list[str | Column], n: int, rank_col: str | None = None
) -> DataFrame:
    """The first n rows of every group in the given total order, ascending or descending, for every n."""
    rank = rank_col or "_rank"
    rows = _trimmed(df, keys, order, n) if n > GROUP_LIMIT else df
    within = Window.partitionBy(*keys).orderBy(*order)
    kept = rows.withColumn(rank, F.row_number().over(within)).filter(F.col(rank) <= n)
    return kept.withColumn(rank, F.col(rank).cast("long")) if rank_col else kept.drop(rank)


def _trimmed(df: DataFrame, keys: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first n rows of every part of a group, which hold the first n of the group.

    Beyond GROUP_LIMIT Spark does not trim before a shuffle; this does, over as
    many parts as there are shuffle partitions, so a hot group never moves
    whole on its key.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(parts))
    spread = df.withColumn("_part", part)
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    return spread.withColumn("_place", F.row_number().over(within)).filter(F.col("_place") <= n).drop("_part", "_place")


def row_numbers(
    df: DataFrame, order: list[str | Column], number_col: str, slices: int | None = None
) -> DataFrame:
    """1, 2, 3, ... over a total order, ascending or descending, with no window over all rows.

    Rows are dealt into slices by ranges of the order and written once with the
    number of their slice; they are numbered inside it and shifted by the sizes
    of the slices before. Any bounds give the same numbers. There are as many
    slices as shuffle partitions, so they keep their size as a cluster grows.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id())
    sliced = written(dealt, "slices")

    # At most one row per slice.
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_slice", F.coalesce(before, F.lit(0)).alias("_before"))

    within = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    return (
        sliced.withColumn("_in_slice", within)
        .join(F.broadcast(offsets), "_slice")
        .select(*df.columns, (F.col("_before") + F.col("_in_slice")).alias(number_col))
    )


def batches(df: DataFrame, order: list[str | Column], batch_size: int) -> DataFrame:
    """Zero-based batch number in queue order."""
    numbered = row_numbers(df, order, "_no")
    batch = F.floor((F.col("_no") - 1) / batch_size).cast("long")
    return numbered.withColumn("batch_no", batch).drop("_no")


def capped_first(df: DataFrame, order: list[str | Column], limit: int | None, offset: int = 0) -> DataFrame:
    """Skip ``offset`` rows, take ``limit``; 0 or None takes all.

    The first PAGE_ROWS rows fit a task. Pages that reach further are cut out
    by row numbers, so no task holds all rows before them.
    """
    if not offset and not limit:
        return df.orderBy(*order)
    if limit and offset + limit <= PAGE_ROWS:
        ordered = df.orderBy(*order)
        return (ordered.offset(offset) if offset else ordered).limit(limit)
    place = F.col("_place")
    kept = row_numbers(df, order, "_place").filter(place > offset)
    if limit:
        kept = kept.filter(place <= offset + limit)
    return kept.orderBy("_place").drop("_place")
