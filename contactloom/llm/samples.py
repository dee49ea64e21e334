"""Bounded, repeatable samples: the rows of each group whose hashes are smallest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.operators.rank import top_n_per_group

SPACE = 1 << 31
# Groups (labels, languages) that take part, the largest ones.
GROUPS = 1000


def sampled(df: DataFrame, keys: list[str], group: str, most: int, groups: int = GROUPS) -> DataFrame:
    """The ``most`` rows of each group whose hash of ``keys`` is smallest; all rows of smaller groups.

    Rows of equal keys are interchangeable, so the sample is the same whatever
    order rows come in. Only the largest ``groups`` groups take part (ties by name); a null group takes none.
    Rows far above the bound are left out where they are, by the sizes of the
    groups, so about twice the sample moves.
    """
    counts = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    sizes = F.broadcast(counts.orderBy(F.desc("_n"), group).limit(groups))
    place = F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(SPACE))
    near = df.join(sizes, group).withColumn("_sample", place).filter(F.col("_sample") < F.lit(2.0 * most * SPACE) / F.col("_n"))
    return top_n_per_group(near, [group], ["_sample", *keys], most).select(*df.columns)
