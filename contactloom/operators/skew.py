"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALTS = 16
# Rows a task works on where it makes several of each or calls a user's function.
TASK_ROWS = 50_000
MAX_HOT = 200
TRACKED = 10_000


def dealt(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` in tasks of about ``task_rows`` rows, however the files it comes from are cut; as it is where no task has twice as many.

    One row group is one task, of any number of rows. Rows go by a hash of all
    their columns, so a common key is spread; only equal rows stay together.
    """
    sizes = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    largest, total = sizes.agg(F.max("n"), F.sum("n")).first()
    if (largest or 0) <= 2 * task_rows:
        return df
    plain = [f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // task_rows))
    return df.repartition(tasks, F.xxhash64(*plain))


def hot_keys(df: DataFrame, key: str, max_hot: int = MAX_HOT, at_least: int = 1000) -> list:
    """Keys holding more than a ``1 / max_hot`` share of the rows: at most ``max_hot`` values.

    One pass over the key column with a bounded sketch and no shuffle of keys.
    The sketch may overcount; that only spreads a key that did not need it.
    """
    top, total = df.agg(
        F.expr(f"approx_top_k({key}, {max_hot}, {TRACKED})"), F.count(F.lit(1))
    ).first()
    floor = max(total / max_hot, at_least)
    return [entry["item"] for entry in top or [] if entry["count"] > floor and entry["item"] is not None]


def salted_join(
    facts: DataFrame, lookup: DataFrame, key: str, how: str, spread: Column, hot: list, salts: int = SALTS
) -> DataFrame:
    """``facts.join(lookup, key, how)`` with hot keys spread over ``salts`` tasks.

    Only lookup rows of hot keys are repeated; the rest moves once. Exact for
    inner, left, left_semi and left_anti whatever ``hot`` contains, because a
    fact row meets every lookup row of its key exactly once. NULL keys never
    match, so where they stay in the result they are spread as well.
    """
    keeps_nulls = how in ("left", "left_anti")
    if not hot and not keeps_nulls:
        return facts.join(lookup, key, how)
    spread_out = F.col(key).isin(hot)
    own = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    left = facts.withColumn("_salt", F.when(spread_out | F.col(key).isNull(), own).otherwise(F.lit(0)))
    copies = F.when(spread_out, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = lookup.filter(F.col(key).isNotNull()).withColumn("_salt", F.explode(copies))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def grid_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_spread: Column,
    right_spread: Column,
    hot: list,
    side: int = 8,
) -> DataFrame:
    """Inner join for keys that may be hot on both sides.

    A hot key becomes a ``side`` x ``side`` grid of tasks: a left row takes one
    grid row and visits all columns, a right row takes one column and visits
    all rows, so each pair meets in exactly one cell.
    """
    if not hot:
        return left.join(right, key)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))

    def own(spread: Column) -> Column:
        return F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(side)).cast("int")).otherwise(F.lit(0))

    visits = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(side - 1))).otherwise(F.array(F.lit(0))))
    cells_left = left.withColumn("_row", own(left_spread)).withColumn("_column", visits)
    cells_right = right.withColumn("_column", own(right_spread)).withColumn("_row", visits)
    return cells_left.join(cells_right, [key, "_row", "_column"]).drop("_row", "_column")
