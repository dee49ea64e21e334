"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.session import written

from .hot import join_counted


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): component is the smallest node reachable.

    Each round points every node of a neighbourhood at its smallest member:
    first the larger neighbours, then the smaller ones. Rounds grow with the
    logarithm of the graph. A hub is one row per task before its neighbourhood
    is summed, and its edges stay where they are in the join; nothing is
    collected. Each round is a written table, so lost executors cost one round.
    """
    state = written(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _mark(state)
    while before[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        met = join_counted(both.filter("v > u"), written(least, "least"), ["u"], "n")
        large = written(met.select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        met = join_counted(large, least, ["u"], "n")
        small = met.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = written(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "edges")
        after = _mark(state)
        if after == before:
            break
        before = after
    # Stars now: every node points at the smallest one.
    nodes = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
