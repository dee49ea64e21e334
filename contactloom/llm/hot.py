"""Joins with a table of counted keys, of which a few may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more than this share of all rows is hot; fewer keys than this can be.
SHARES = 1000


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``table``, one row per key, whose column ``n`` is the key's weight in ``rows``.

    Keys of more than a thousandth of the weight of all, so fewer than a
    thousand, are broadcast and their rows stay where they are; all others are
    joined as usual. Both inputs are read more than once: give written ones.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * SHARES > F.lit(total)
    hot = F.broadcast(table.filter(is_hot))
    rest = rows.join(F.broadcast(table.filter(is_hot).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(table.filter(~is_hot), keys, how))
