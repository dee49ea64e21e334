"""Skew helpers against brute force, and the shape of the plans."""

import random

import pytest
from pyspark.sql import functions as F

from contactloom.functions.text import SPACE_CHARS
from contactloom.operators import rank, skew, store
from contactloom.operators.finders import StaticFinder


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, some under NULL."""
    draw = random.Random(3)
    rows = [
        (i, 7 if i % 3 == 0 else (None if i % 50 == 1 else draw.randint(0, 400)), draw.randint(0, 30)) for i in range(9000)
    ]
    return spark.createDataFrame(rows, "id bigint, k bigint, o bigint").repartition(6).cache()


def test_hot_keys(spark, skewed):
    assert skew.hot_keys(skewed, "k", at_least=100) == [7]
    assert skew.hot_keys(skewed.limit(0), "k") == []


@pytest.mark.parametrize("hot", [[], [7, 11]])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, skewed, how, hot):
    lookup = spark.range(0, 300).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x")).filter("k % 2 = 1")
    plain = skewed.join(lookup, "k", how)
    salted = skew.salted_join(skewed, lookup, "k", how, F.col("id"), hot)
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.select(salted.columns).collect()))


def test_grid_join_equals_plain_join(spark, skewed):
    left = skewed.select("k", "id").filter("id < 900")
    right = skewed.select("k", F.col("o").alias("y"), F.col("id").alias("rid")).filter("id >= 8000")
    plain = left.join(right, "k").groupBy().agg(F.count("*"), F.sum(F.hash("k", "id", "rid"))).first()
    grid = skew.grid_join(left, right, "k", F.col("id"), F.col("rid"), [7])
    assert grid.groupBy().agg(F.count("*"), F.sum(F.hash("k", "id", "rid"))).first() == plain


def test_row_numbers(spark, skewed):
    numbered = {r["id"]: r["no"] for r in rank.row_numbers(skewed, ["k", "o", "id"], "no", slices=7).collect()}
    rows = sorted(skewed.collect(), key=lambda r: (r["k"] is not None, r["k"] or 0, r["o"], r["id"]))
    assert numbered == {r["id"]: i for i, r in enumerate(rows, 1)}
    assert rank.row_numbers(skewed.limit(0), ["id"], "no").count() == 0


@pytest.mark.parametrize("n", [3, 1500])
def test_top_n_of_hot_group(spark, skewed, n):
    """Small n trims before the shuffle, large n numbers all rows; both are exact."""
    got = {r["id"]: r["pos"] for r in rank.top_n_per_group(skewed, ["k"], ["o", "id"], n, "pos").collect()}
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r["k"], []).append((r["o"], r["id"]))
    want = {i: p for rows in groups.values() for p, (_, i) in enumerate(sorted(rows), 1) if p <= n}
    assert got == want


def test_first_wins_trims_before_the_shuffle(skewed):
    text = plan(rank.first_wins(skewed, ["k"], ["o", "id"]))
    assert text.count("WindowGroupLimit") == 2
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_static_finder_needs_no_shuffle(spark):
    companies = spark.range(10).select("id", F.lit("n").alias("name"), F.concat(F.lit("c"), "id", F.lit(".com")).alias("website"))
    text = plan(StaticFinder().find(companies, "2024-01-01 00:00:00"))
    assert "Exchange" not in text and "Join" not in text


def test_dedup_and_anti_join_share_one_shuffle(spark, skewed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = skewed.select(
            F.col("k").alias("company_id"), F.concat("o", F.lit("@x.com")).alias("email"), F.lit("s").alias("source"),
            F.lit(0).alias("method_ord"), F.col("id").alias("seq"),
        )
        text = plan(store.new_email_rows(found, found.select("company_id", "email"), ["method_ord", "seq"]))
        assert text.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_reaches_the_scan(spark, sf_dir):
    from contactloom.sources import tables

    customers = tables.map_companies(
        spark.read.parquet(f"{sf_dir}/customer.parquet"), {"id": "c_custkey", "name": "c_name", "website": "c_mktsegment"}
    )
    text = plan(tables.by_id(customers, 42))
    assert "EqualTo(c_custkey,42)" in text and "c_acctbal" not in text


def test_space_characters():
    assert SPACE_CHARS.strip() == "" and len(SPACE_CHARS) == sum(chr(i).isspace() for i in range(0x10000))
