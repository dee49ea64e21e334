"""Finders, their registry, and the jobs built on them."""

import glob

import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from contactloom import schema
from contactloom.functions import patterns as P
from contactloom.operators.finders import HarvestFinder, Registry, SiteFinder, StaticFinder
from contactloom.operators.guarded import guarded
from contactloom.plans import check as check_plans
from contactloom.plans import find as find_plans
from contactloom.session import run

AS_OF = "2024-01-01 00:00:00"


def companies(spark, rows):
    return spark.createDataFrame(rows, "id bigint, name string, website string")


def tracked(spark, rows):
    return schema.conform(companies(spark, rows), schema.COMPANIES)


def locals_of(df):
    return [r["email"].split("@")[0] for r in df.orderBy("company_id", "seq").collect()]


CASES = [
    ("Thoughtworks", "thoughtworks.com", "info contact hello sales business", 5),
    ("Tech Solutions Inc", "https://www.techsolutions.com", "info contact hello sales support", 5),
    ("Tech Solutions Inc", "https://www.techsolutions.com", "info contact hello sales support help service business", 8),
    ("HR Consulting Group", "https://hr-consulting.co.uk/x", "info contact hello sales support", 5),
]


@pytest.mark.parametrize("name,website,want,k", CASES)
def test_static_smart(spark, name, website, want, k):
    finder = StaticFinder(0.7, k, names=("info", "contact", "sales", "hr"))
    assert locals_of(finder.find(companies(spark, [(1, name, website)]), AS_OF)) == want.split()


def test_static_row(spark):
    row = StaticFinder().find(companies(spark, [(1, "x", "http://www.X.org/")]), AS_OF).orderBy("seq").first()
    assert row["email"] == "info@x.org" and row["confidence"] == 0.95
    assert row["source_details"] == "Static pattern: General information email"
    assert row["metadata"] == {"pattern": "info", "category": "general", "domain": "x.org"}


def test_keyword_options(spark):
    c = companies(spark, [(1, "Princeton Furniture", "p.org")])

    def categories(match):
        rows = StaticFinder(0.0, 26, match=match).find(c, AS_OF).collect()
        return {r["metadata"]["category"] for r in rows}

    assert categories("substring") == {"general", "business", "technical", "hr", "marketing"}
    assert categories("word") == {"general", "business"}


def test_smart_list_equals_direct_choice(spark):
    """The constant per flag triple equals ranking the chosen patterns, for all eight."""
    names = ["x", "tech", "service", "corp", "tech service", "tech corp", "service corp", "tech service corp"]
    c = companies(spark, [(i, n, "x.org") for i, n in enumerate(names)])
    for i, n in enumerate(names):
        chosen = P.by_category(P.chosen_categories("tech" in n, "service" in n, "corp" in n))
        want = [p.name for p in P.ranked(chosen, 0.55, 12)]
        assert locals_of(StaticFinder(0.55, 12).find(c.filter(F.col("id") == i), AS_OF)) == want


def test_pattern_choice(spark):
    assert [p.name for p in P.by_category(["legal", "nope", "technical"])] == ["legal", "admin", "webmaster", "it"]
    assert [p.position for p in P.by_category(None)] == list(range(1, 27))
    assert [p.name for p in P.by_confidence(0.8)] == ["info", "contact", "hello", "sales", "support"]
    assert [p.name for p in P.by_name(["hr", "x", "info", "hr"])] == ["hr", "info"]
    assert P.override(P.by_name(["hr"]), {"hr": 1})[0].confidence == 1.0
    assert [p.name for p in P.configured(["hr"], ["legal"])] == ["hr"]
    assert [p.name for p in P.configured(None, ["legal"])] == ["legal"]
    assert P.pattern_dimension(spark).filter("ord = 14").first()["pattern"] == "support"


@pytest.fixture(scope="module")
def registry(spark):
    results = spark.createDataFrame(
        [(1, '{"emails": ["INFO@a.com", "x@a.com"]}'), (3, '{"emails": []}')], "company_id bigint, body string"
    )
    pages = spark.createDataFrame(
        [(1, "https://www.a.com/p", "<p>boss@a.com x@a.com</p>"), (2, "http://b.com/", "nothing")],
        "page_id bigint, url string, html string",
    )
    return Registry(StaticFinder(0.9, 8), HarvestFinder(results), SiteFinder(pages))


ROWS = [(1, "A", "a.com"), (2, "B", "http://b.com/x"), (3, "C", "bad"), (4, None, "c.com")]


def test_find_emails(spark, registry):
    found = find_plans.find_emails(tracked(spark, ROWS), registry, AS_OF)
    got = sorted((r["company_id"], r["method"], r["email"]) for r in found.collect())
    assert got == [
        (1, "harvester", "info@a.com"), (1, "harvester", "x@a.com"), (1, "scraper", "boss@a.com"),
        (1, "scraper", "x@a.com"), (1, "static", "contact@a.com"), (1, "static", "info@a.com"),
        (2, "static", "contact@b.com"), (2, "static", "info@b.com"),
        (4, "static", "contact@c.com"), (4, "static", "info@c.com"),
    ]
    assert find_plans.find_emails(tracked(spark, ROWS), registry, AS_OF, ["nope"]).count() == 0
    assert registry.available() == ["static", "harvester", "scraper"]


def test_track_policies(spark, registry):
    """A company a finder failed for is used, not completed."""
    c = tracked(spark, ROWS)
    finders = [(0, registry.finders["scraper"])]
    found = registry.finders["scraper"].find(c, AS_OF)

    def log(policy):
        rows = find_plans.run_log(c, found, finders, policy).collect()
        return sorted({(r["company_id"], r["completed"]) for r in rows})

    assert log("cli") == [(1, True), (2, True), (3, True), (4, False)]
    assert log("finder") == [(1, True), (2, True), (4, False)]
    assert log("workflow") == [(1, True)]


def test_bulk_find_merges_listed_addresses(spark):
    c = tracked(spark, ROWS).withColumn("existing", F.lit(" INFO@a.com, ceo@a.com,bad,ceo@a.com"))
    done = find_plans.bulk_find(c, schema.empty_table(spark, schema.EMAILS), StaticFinder(0.95, 1), AS_OF, limit=1)
    assert sorted((r["email"], r["source"]) for r in done.added.collect()) == [
        ("ceo@a.com", "existing"), ("info@a.com", "static"),
    ]
    assert [tuple(r) for r in done.counts.collect()] == [(1, 1, 2, 2)]
    methods = {r["id"]: r["email_methods_completed"] for r in done.companies.collect()}
    assert methods == {1: ["static"], 2: None, 3: None, 4: None}


def test_complete_workflow(spark, registry):
    replies = spark.createDataFrame(
        [(1, "X@a.com", '{"is_reachable": "safe"}'), (2, "info@b.com", '{"error": "timeout"}'),
         (9, "no@one.com", '{"is_reachable": "safe"}')],
        "company_id bigint, email string, reply string",
    ).withColumn("email", F.lower("email"))
    done = find_plans.complete_workflow(
        tracked(spark, ROWS), schema.empty_table(spark, schema.EMAILS), registry, AS_OF, replies=replies
    )
    emails = {(r["company_id"], r["email"]): r for r in done.emails.collect()}
    assert len(emails) == 8
    assert emails[1, "x@a.com"]["is_reachable"] == "safe" and emails[1, "x@a.com"]["source"] == "harvester"
    assert emails[2, "info@b.com"]["check_error"] == "timeout"
    assert emails[4, "info@c.com"]["checked_at"] is None
    assert done.totals.first().asDict() == {
        "companies_processed": 4, "total_emails_found": 10, "total_emails_checked": 2,
    }
    assert {r["id"]: r["email_methods_completed"] for r in done.companies.collect()} == {
        1: ["static", "harvester", "scraper"], 2: ["static"], 3: None, 4: ["static"],
    }


def test_check_pipeline_bounds(spark):
    emails = schema.conform(
        spark.range(1, 6).select(
            "id", F.lit(1).alias("company_id"), F.concat("id", F.lit("@x.com")).alias("email"), F.lit("s").alias("source"),
            F.timestamp_seconds(F.lit(100) - F.col("id")).cast("timestamp_ntz").alias("created_at"),
        ),
        schema.EMAILS,
    )
    replies = emails.select("company_id", "email", F.lit('{"is_reachable": "safe"}').alias("reply"))
    twice = replies.unionByName(replies.withColumn("reply", F.lit('{"error": "zz"}')))
    snapshot = check_plans.check_pipeline(emails, twice, AS_OF, limit=4, max_requests=2)
    assert sorted(r["id"] for r in snapshot.filter("checked_at IS NOT NULL").collect()) == [4, 5]
    assert check_plans.n_checked(snapshot, AS_OF).first()["n_checked"] == 2
    assert snapshot.count() == 5
    none = check_plans.check_pipeline(emails, replies, AS_OF, checker=check_plans.NoChecker())
    assert none.filter("check_error = 'no_checker_available'").count() == 5


def test_user_finder(spark):
    """A finder of the user's own may run pandas code inside its tasks."""

    class Shouting:
        name, enabled = "shouting", True

        def attempts(self, c):
            return c.select(F.col("id").alias("company_id"), F.lit(True).alias("valid"), F.lit(True).alias("succeeded"))

        def find(self, c, as_of, method_ord):
            def shout(frames):
                for f in frames:
                    yield f.assign(email=f["name"].str.upper() + "@loud.org")[["company_id", "email"]]

            rows = c.select(F.col("id").alias("company_id"), "name").mapInPandas(shout, "company_id bigint, email string")
            return schema.conform(rows.withColumn("method", F.lit(self.name)), schema.FOUND)

    registry = Registry(StaticFinder(0.95, 1), Shouting())
    found = find_plans.find_emails(tracked(spark, [(1, "a", "x.com")]), registry, AS_OF)
    assert sorted(r["email"] for r in found.collect()) == ["A@loud.org", "info@x.com"]
    assert [f.name for _, f in Registry(StaticFinder(enabled=False), Shouting()).selected()] == ["shouting"]


def test_priority_orders_methods(spark, registry):
    late = Registry(StaticFinder(priority=200), *[registry.finders[m] for m in ("harvester", "scraper")])
    assert [f.name for _, f in late.selected()] == ["harvester", "scraper", "static"]
    assert [f.name for _, f in late.selected(["static", "nope", "scraper"])] == ["static", "scraper"]


@pytest.mark.parametrize(
    "depth,limit_urls,want", [(-1, None, "deep far home next"), (1, None, "home"), (2, None, "home next"), (-1, 2, "home next")]
)
def test_site_depth(spark, depth, limit_urls, want):
    pages = spark.createDataFrame(
        [
            (1, "https://www.s.org", '<a href="/n">n</a> home@s.org'),
            (2, "https://www.s.org/n?x=1", '<a href="d">d</a> next@s.org'),
            (3, "https://www.s.org/d", "deep@s.org"),
            (4, "https://www.s.org/unlinked", "far@s.org"),
        ],
        "page_id bigint, url string, html string",
    )
    found = SiteFinder(pages, depth, limit_urls).find(companies(spark, [(1, "S", "s.org")]), AS_OF)
    assert sorted(locals_of(found)) == want.split()
    assert {r["metadata"]["crawl_depth"] for r in found.collect()} == {str(depth)}


def test_user_function_runs_in_many_tasks(spark):
    """A table of one partition (one row group) is no single task of calls."""
    layout = schema.T.StructType([schema.T.StructField("id", schema.T.LongType()), schema.T.StructField("task", schema.T.LongType())])

    def fn(frame):
        if (frame["id"] == 7).any():
            raise ValueError("seven")
        return pd.DataFrame({"id": frame["id"], "task": TaskContext.get().partitionId()})

    done = guarded(spark.range(0, 30_000, 1, 1), fn, layout, ["id"])
    assert done.rows.select("task").distinct().count() > 1
    assert done.rows.select("id").distinct().count() == 29_999
    assert [tuple(r) for r in done.errors.collect()] == [(7, "ValueError: seven")]


def test_bulk_run_of_one_partition_runs_in_many_tasks(spark):
    c = schema.conform(spark.range(0, 120_000, 1, 1).selectExpr("id", "'A' AS name", "concat('c', id, '.org') AS website"), schema.COMPANIES)
    done = find_plans.bulk_find(c, schema.empty_table(spark, schema.EMAILS), StaticFinder(0.95, 1), AS_OF)
    assert len(done.found.inputFiles()) > 1
    assert done.added.count() == 120_000


HOST_ROWS = [(i, "S", "big.org") for i in range(40)] + [
    (40, "S", "big.org"), (40, "S", "big.org"), (41, "S", "big.org"), (41, "S", "other.org"), (None, "S", "big.org"), (None, "S", "other.org"),
    (42, "S", "none.org"), (43, "S", None),
]
HOST_MAILS = {"big.org": [f"m{i}@big.org" for i in range(99)] + ["info@big.org"], "other.org": ["m1@big.org", "o@other.org"]}


@pytest.fixture(scope="module")
def shared_host(spark):
    pages = [(i, f"http://{d}/{i}", f"<p>{m}</p>") for i, (d, m) in enumerate((d, m) for d, all_ in HOST_MAILS.items() for m in all_)]
    results = [(3, '["m3@big.org", "x@y.org"]'), (40, '["m4@big.org"]')]
    held = [(5, m) for m in HOST_MAILS["big.org"][:80]] + [(6, "m0@big.org"), (6, "far@big.org"), (41, "m1@big.org"), (None, "m0@big.org")]
    stored = spark.createDataFrame([(i, m, "old") for i, m in held], "company_id bigint, email string, source string")
    registry = Registry(
        SiteFinder(spark.createDataFrame(pages, "page_id bigint, url string, html string"), priority=2),
        HarvestFinder(spark.createDataFrame(results, "company_id bigint, body string"), priority=1),
        StaticFinder(0.9, 8, priority=3),
    )
    return registry, schema.conform(stored, schema.EMAILS), held


def test_shared_host_is_not_multiplied(spark, shared_host):
    """The workflow writes no table with a row for every company and address, and gives all of them all the same."""
    registry, stored, held = shared_host
    said = [(2, "m2@big.org", "safe"), (2, "M2@big.org", "safe"), (40, "m9@big.org", "safe"), (5, "m1@big.org", "risky"), (9, "gone@big.org", "safe")]
    replies = spark.createDataFrame([(i, m, f'{{"is_reachable": "{r}"}}') for i, m, r in said], "company_id bigint, email string, reply string")
    order = {"harvester": 0, "scraper": 1, "static": 2}
    found = [(i, m, "scraper") for i, _, d in HOST_ROWS for m in HOST_MAILS.get(d, ())]
    found += [(3, "m3@big.org", "harvester"), (3, "x@y.org", "harvester"), *[(40, "m4@big.org", "harvester")] * 2]
    found += [(i, f"{x}@{d}", "static") for i, _, d in HOST_ROWS if d for x in ("info", "contact")]
    best = {}
    for i, m, s in sorted(found, key=lambda r: order[r[2]]):
        best.setdefault((i, m), s)
    results = {(2, "m2@big.org"): "safe", (40, "m9@big.org"): "safe", (5, "m1@big.org"): "risky"}
    taken = {(i, m) for i, m in held if i is not None}
    want = [(i, m, "old") for i, m in held] + [(i, m, s) for (i, m), s in best.items() if (i, m) not in taken]

    with run(spark) as folder:
        done = find_plans.complete_workflow(tracked(spark, HOST_ROWS), stored, registry, AS_OF, replies=replies)
        emails = [(r.company_id, r.email, r.source, r.is_reachable) for r in done.emails.collect()]
        assert sorted(map(str, emails)) == sorted(str((*w, results.get(w[:2]))) for w in want)
        assert sorted(map(str, ((r.company_id, r.email, r.method) for r in done.found.collect()))) == sorted(map(str, found))
        checked = sum((i, m) in results for i, m, _ in found)
        # Every row of a repeated company counts what its id has; rows without an id have no count.
        counted = sum(j == i is not None for i, _, _ in HOST_ROWS for j, _, _ in found)
        assert tuple(done.totals.first()) == (len(HOST_ROWS), counted, checked)
        ran = {r.id: r.email_methods_completed for r in done.companies.collect()}
        assert ran[0] == ["scraper", "static"] and ran[3] == ["harvester", "scraper", "static"] and ran[42] == ["static"] and ran[43] is None
        assert max(spark.read.parquet(p).count() for p in glob.glob(f"{folder}/*-*") if glob.glob(f"{p}/*.parquet")) < 1000


def test_shared_host_bulk_run(spark, shared_host):
    registry, stored, held = shared_host
    c = tracked(spark, HOST_ROWS).withColumn("existing", F.lit("M7@big.org, own@big.org"))
    with run(spark):
        done = find_plans.bulk_find(c, stored, registry.finders["scraper"], AS_OF)
        added = [(r.company_id, r.email, r.source) for r in done.added.collect()]
        counts = {r.company_id: tuple(r)[1:] for r in done.counts.collect()}
    taken = {(i, m) for i, m in held if i is not None}
    scraped = {(i, m) for i, _, d in HOST_ROWS for m in HOST_MAILS.get(d, ())}
    listed = {(i, m) for i, _, d in HOST_ROWS if d for m in ("m7@big.org", "own@big.org")} - scraped
    want = [(*k, "scraper") for k in scraped - taken] + [(*k, "existing") for k in listed - taken]
    assert sorted(map(str, added)) == sorted(map(str, want))
    assert counts[0] == (100, 1, 101) and counts[5] == (100, 1, 21) and counts[40] == (200, 2, 101) and counts[42] == (0, 2, 2)
