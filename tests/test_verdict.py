"""Deep pages, tables of placeholders, mapped tables in a bulk run, site visits without a root page."""

import pytest
from pyspark.sql import functions as F

from contactloom import schema
from contactloom.operators import rank
from contactloom.operators.finders import SiteFinder, StaticFinder
from contactloom.plans.find import bulk_find
from contactloom.sources import tables

AS_OF = "2024-06-01 00:00:00"


@pytest.mark.parametrize("limit, offset", [(5, 0), (5, 20), (None, 290), (0, 0), (50, 280), (5, 400)])
def test_pages_are_the_same_on_both_paths(spark, monkeypatch, limit, offset):
    table = spark.range(300).select(F.pmod(F.col("id") * 7, F.lit(300)).alias("id"))
    want = list(range(300))[offset:][: limit or None]
    assert [r.id for r in rank.capped_first(table, ["id"], limit, offset).collect()] == want
    monkeypatch.setattr(rank, "PAGE_ROWS", 10)
    assert [r.id for r in rank.capped_first(table, ["id"], limit, offset).collect()] == want


def test_a_deep_page_is_not_sorted_in_one_task(spark):
    page = rank.capped_first(spark.range(100), ["id"], 5_000_000)
    assert "TakeOrderedAndProject" not in page._jdf.queryExecution().executedPlan().toString()


def test_numbers_in_descending_order(spark):
    table = spark.range(50).select(F.when(F.col("id") > 4, F.col("id")).alias("v"), "id")
    got = rank.row_numbers(table, [F.desc("v"), "id"], "no", slices=4).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.no)] == [*range(49, 4, -1), *range(5)]


def test_placeholders_from_tables_equal_those_from_lists(spark):
    texts = ["a ${country}", "b ${state}", "${country} ${state}", "plain", None]
    templates = spark.createDataFrame(list(enumerate(texts)), "id int, template string")
    lists = [f"C{i}" for i in range(1200)], ["S1", "S2"]
    frames = [spark.createDataFrame([(v,) for v in values], "name string") for values in lists]
    want = tables.expand_queries(templates, *lists).groupBy("id").agg(F.count("*"), F.min("query"), F.max("query"))
    got = tables.expand_queries(templates, *frames).groupBy("id").agg(F.count("*"), F.min("query"), F.max("query"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_bulk_run_on_a_mapped_table(spark):
    rows = [(1, "A", "a.com", '["static"]'), (2, "B", "b.com", None), (3, "C", "c.com", "no list")]
    raw = spark.createDataFrame(rows, "nr long, title string, site string, done string")
    names = {"id": "nr", "name": "title", "website": "site", "email_methods_completed": "done"}
    stored = schema.empty_table(spark, schema.EMAILS)
    run = bulk_find(tables.map_companies(raw, names, tracking=True), stored, StaticFinder(), AS_OF)
    assert {r.company_id for r in run.added.collect()} == {2, 3}
    assert {r.id: r.email_methods_completed for r in run.companies.collect()} == {1: ["static"], 2: ["static"], 3: ["static"]}


@pytest.mark.parametrize("depth, want", [(-1, {"a", "b"}), (1, {"a"}), (2, {"a", "b"})])
def test_visit_without_a_root_page_and_across_spellings(spark, depth, want):
    pages = [
        (1, "http://y.com/index.html", 'a@y.com <a href="https://www.Y.com/p/q">next</a>'),
        (2, "https://y.com/p/q", "b@y.com"),
    ]
    archive = spark.createDataFrame(pages, "page_id long, url string, html string")
    companies = spark.createDataFrame([(1, "Y", "y.com"), (2, "Y too", "www.y.com")], "id long, name string, website string")
    found = SiteFinder(archive, depth=depth).find(companies, AS_OF).select("company_id", "email").collect()
    assert {(r.company_id, r.email) for r in found} == {(c, f"{x}@y.com") for c in (1, 2) for x in want}
    capped = SiteFinder(archive, depth=depth, limit=1).find(companies, AS_OF).collect()
    assert sorted((r.company_id, r.email) for r in capped) == [(1, "a@y.com"), (2, "a@y.com")]
