"""Guarded plug-ins, walks with a budget, odd documents, check runs in batches, missing packages, fixed patterns."""

import builtins
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from contactloom import schema
from contactloom.functions.patterns import PATTERN_ROWS
from contactloom.operators import checks, links, report_state
from contactloom.operators.finders import Registry, StaticFinder
from contactloom.operators.guarded import GuardedFinder, guarded
from contactloom.plans.check import check_run
from contactloom.plans.find import bulk_find, find_emails
from contactloom.operators.shared import SharedRows
from contactloom.session import new_path, run, sweep_runs, work_dir, written
from contactloom.sources import results
from contactloom.sources.files import Folder

AS_OF = "2024-06-01 00:00:00"
LAYOUT = schema.T.StructType([schema.FOUND[c] for c in ("company_id", "email")])


def test_a_bad_row_costs_itself_only(spark):
    def fn(frame):
        if frame["id"].isin([13, 70]).any():
            raise KeyError("bad company")
        return frame.assign(company_id=frame["id"], email="x@y.com")

    done = guarded(spark.range(100), fn, LAYOUT, ["id"], batch_rows=16)
    assert sorted(r.company_id for r in done.rows.collect()) == [i for i in range(100) if i not in (13, 70)]
    assert sorted(tuple(r) for r in done.errors.collect()) == [(13, "KeyError: 'bad company'"), (70, "KeyError: 'bad company'")]
    none = guarded(spark.range(0), fn, LAYOUT, ["id"])
    assert none.rows.count() == 0 and none.errors.count() == 0


def test_results_of_a_wrong_kind_are_errors(spark):
    wrong = {1: lambda f: None, 2: lambda f: f.assign(company_id="text", email=1), 3: lambda f: f.drop(columns="id")}

    def fn(frame):
        if len(frame) > 1:
            raise ValueError
        i = int(frame["id"].iloc[0])
        return wrong.get(i, lambda f: f.assign(company_id=f["id"], email=None))(frame)

    done = guarded(spark.range(5), fn, LAYOUT, ["id"])
    assert sorted(r.id for r in done.errors.collect()) == [1, 2, 3]
    assert sorted(tuple(r) for r in done.rows.collect()) == [(0, None), (4, None)]


def test_a_finder_that_raises_for_one_company(spark):
    companies = spark.createDataFrame([(i, f"n{i}", f"www.c{i}.com") for i in range(6)], "id long, name string, website string")

    def fn(frame):
        if (frame["id"] == 4).any():
            raise RuntimeError("timeout")
        return frame.assign(company_id=frame["id"], email=frame["name"] + "@user.org", confidence=0.4)

    finder = GuardedFinder("user", fn)
    found = find_emails(companies, Registry(StaticFinder(max_emails=1), finder), AS_OF)
    assert found.filter("method = 'user'").count() == 5 and found.filter("method = 'static'").count() == 6
    queue = schema.conform(companies, schema.COMPANIES)
    done = bulk_find(queue, schema.empty_table(spark, schema.EMAILS), finder, AS_OF)
    tracked = {r.id: r.email_methods_completed for r in done.companies.collect()}
    assert tracked == {i: [] if i == 4 else ["user"] for i in range(6)}
    assert [r.company_id for r in finder.errors(queue).collect()] == [4]


def site(spark, width):
    """A home page with many links, each to further pages of its own."""
    link = lambda paths: "".join(f'<a href="{p}">x</a>' for p in paths)
    rows = [("http://a.com/", link(f"/p{i:03}" for i in range(width)))]
    rows += [(f"http://a.com/p{i:03}", link(f"/p{i:03}/q{j}" for j in range(5))) for i in range(width)]
    rows += [("http://b.com/", link(["/only"])), ("http://b.com/only", link(["/deep"])), ("http://b.com/deep", "")]
    return spark.createDataFrame(rows, "url string, html string")


@pytest.mark.parametrize("cap", [1, 2, 7, 30, 1000])
def test_a_capped_walk_is_the_start_of_the_whole_one(spark, cap):
    pages = site(spark, 20)
    seeds = pages.filter("url in ('http://a.com/', 'http://b.com/')")
    whole = sorted((r.host, r.depth, r.url) for r in links.pages_in_scope(seeds, pages).collect())
    want = [r for h in ("a.com", "b.com") for r in [x for x in whole if x[0] == h][:cap]]
    assert sorted((r.host, r.depth, r.url) for r in links.pages_in_scope(seeds, pages, limit_urls=cap).collect()) == want


def test_pages_beyond_the_cap_are_never_expanded(spark):
    pages = site(spark, 20)
    reached = links.pages_in_scope(pages.filter("url = 'http://a.com/'"), pages, limit_urls=7)
    # What lies in the folder of the walk is all it ever wrote down: the cap, and nothing of the third hop.
    assert reached.count() == 7 and reached.filter("depth > 2").count() == 0


@pytest.mark.parametrize(
    "body, want",
    [
        ('[{"score": NaN, "email": "a@x.com"}]', ["a@x.com"]),
        ('{"email": "a@x.com", "email": "b@x.com", "n": -Infinity}', ["a@x.com", "b@x.com"]),
        ('["NaN", NaN, "a@x.com"', None),
        ('["a@x.com"] [', None),
        ("NaN a@x.com", None),
        ("[" + ", ".join(f'"u{i}@x.com"' for i in range(3)) + ', "' + "y" * (17 << 20) + '"]', [f"u{i}@x.com" for i in range(3)]),
    ],
)
def test_documents_the_variant_parser_refuses(spark, body, want):
    docs = spark.createDataFrame([(1, body)], "company_id long, body string")
    got = sorted(r.email for r in results.emails_from_results(docs, ["company_id"]).collect())
    assert got == (want or [])
    assert results.rejected_results(docs).count() == (want is None)


def test_text_behind_a_reply(spark):
    replies = ['{"is_reachable": "safe"} and more', '{"is_reachable": "safe"}', ' {"is_reachable": "risky"} \n', '{"a": 1}{"b": 2}']
    rows = spark.createDataFrame(list(enumerate(replies)), "company_id long, reply string").withColumn("email", F.lit("a@x.com"))
    got = sorted((r.company_id, r.is_error, r.check_error, r.is_reachable) for r in checks.flatten_replies(rows).collect())
    assert got == [(0, True, "json_decode_error", None), (1, False, None, "safe"), (2, False, None, "risky"), (3, True, "json_decode_error", None)]


def test_batches_of_a_check_run(spark):
    rows = [(i, f"a{i}@x.com", i, None if i else "done") for i in range(10)]
    emails = spark.createDataFrame(rows, "company_id long, email string, id long, d string")
    emails = schema.conform(emails.withColumn("checked_at", F.when(F.col("d").isNotNull(), schema.instant(AS_OF))).drop("d"), schema.EMAILS)
    replies = spark.createDataFrame([(i, f"a{i}@x.com", '{"error": "x"}' if i % 2 else '{"is_reachable": "safe"}') for i in range(8)], "company_id long, email string, reply string")
    run = check_run(emails, replies, AS_OF, batch_size=4)
    assert sorted(tuple(r) for r in run.batches.collect()) == [(0, 4, 4, 2), (1, 4, 3, 2), (2, 1, 0, 0)]
    assert run.snapshot.filter("is_reachable = 'safe'").count() == 3
    few = check_run(emails, replies, AS_OF, batch_size=4, limit=9, max_requests=5)
    assert sorted(tuple(r) for r in few.batches.collect()) == [(0, 4, 4, 2), (1, 1, 1, 1)]


def test_a_missing_package_takes_only_the_optional_queries(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("contactloom.llm", "corpus_pipeline", "ahocorasick"))]:
        monkeypatch.delitem(sys.modules, name)
    real = builtins.__import__

    def gone(name, *args, **kwargs):
        if name.split(".")[0] == "ahocorasick":
            raise ImportError("No module named 'ahocorasick'", name="ahocorasick")
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", gone)
    assert len(entry_point.queries()) > 100


def test_role_patterns():
    """Order, confidence and category of the fixed values; the checking SQL takes them from the library."""
    assert len(PATTERN_ROWS) == 26 and len({r[1] for r in PATTERN_ROWS}) == 26
    by_name = {r[1]: r[2:4] for r in PATTERN_ROWS}
    assert by_name == {
        "info": (0.95, "general"), "contact": (0.9, "general"), "hello": (0.85, "general"), "sales": (0.8, "business"),
        "support": (0.8, "support"), "help": (0.75, "support"), "service": (0.75, "support"), "hr": (0.7, "hr"),
        "careers": (0.7, "hr"), "jobs": (0.65, "hr"), "recruitment": (0.65, "hr"), "business": (0.7, "business"),
        "partnerships": (0.6, "business"), "bd": (0.6, "business"), "marketing": (0.65, "marketing"),
        "media": (0.6, "marketing"), "press": (0.6, "marketing"), "admin": (0.65, "technical"),
        "webmaster": (0.55, "technical"), "it": (0.6, "technical"), "finance": (0.6, "finance"),
        "accounting": (0.6, "finance"), "legal": (0.55, "legal"), "office": (0.5, "general"), "team": (0.5, "general"),
        "mail": (0.45, "general"),
    }
    assert sorted(r[0] for r in PATTERN_ROWS) == list(range(1, 27))


def test_a_shared_host_is_not_multiplied(spark):
    members = spark.range(100_000).select(F.col("id").alias("company_id"), F.lit("big.com").alias("domain"))
    addresses = spark.range(100_000).select(F.lit("big.com").alias("domain"), F.concat(F.lit("A"), "id", F.lit("@big.com")).alias("email"))
    rows = SharedRows.of(members, addresses)
    stored = spark.createDataFrame([(7, "a1@big.com"), (7, "a2@big.com"), (8, "x@other.com"), (-1, "a1@big.com")], "company_id long, email string")
    left = rows.without(stored)
    assert [tuple(r) for r in left.totals().collect()] == [(100_000, 100_000, 10**10 - 2)]
    assert left.counts().filter("n <> 100000").collect() == [(7, 99_998)] and left.counts().count() == 100_000
    one = left.expand(spark.createDataFrame([(7,)], "company_id long"))
    assert one.count() == 99_998


def test_shared_rows_equal_their_expansion(spark, tmp_path):
    companies = [(i, f"d{i % 4}.com") for i in range(23)] + [(99, None), (5, "d1.com")]
    found = [(f"d{i % 5}.com", f" U{i}@x.com") for i in range(17)] + [(None, "a@x.com"), ("d1.com", "u1@x.com"), ("d1.com", None)]
    rows = SharedRows.of(spark.createDataFrame(companies, "company_id long, domain string"), spark.createDataFrame(found, "domain string, email string"))
    rows = rows.without(spark.createDataFrame([(1, "u1@x.com"), (2, "u1@x.com")], "company_id long, email string"))
    rows.save(f"{tmp_path}/shared")
    for r in (rows, SharedRows.load(spark, f"{tmp_path}/shared")):
        pairs = [(p.company_id, p.email) for p in r.expand().collect()]
        assert len(set(pairs)) == len(pairs) and (1, "u1@x.com") not in pairs and (5, "u1@x.com") in pairs
        per = {c: sum(1 for p in pairs if p[0] == c) for c, _ in pairs}
        assert {c.company_id: c.n for c in r.counts().collect()} == per
        total = r.totals().first()
        assert (total.n_companies, total.n_pairs) == (len(per), len(pairs))


def test_carried_reports_equal_recounts(spark):
    rows = [(i, i % 7, f"a{i}@d{i % 50}.com", "static" if i % 2 else "scraper", f"2024-01-0{1 + i % 3} 10:00:00", i % 5 == 0, i % 10 == 0) for i in range(400)]
    raw = spark.createDataFrame(rows, "id long, company_id long, email string, source string, t string, c boolean, s boolean")
    emails = schema.conform(
        raw.withColumn("created_at", F.col("t").cast("timestamp_ntz")).withColumn("checked_at", F.when(F.col("c"), schema.instant(AS_OF))).withColumn("is_reachable", F.when(F.col("s"), "safe")),
        schema.EMAILS,
    )
    whole = report_state.email_state(emails)
    parts = [report_state.email_state(emails.filter(f"id % 3 = {i}")) for i in range(3)]
    assert sorted(map(str, report_state.report(report_state.merged(*parts), "day", "source").collect())) == sorted(map(str, report_state.report(whole, "day", "source").collect()))
    total = report_state.report(report_state.merged(report_state.merged(*parts[:2]), parts[2])).first()
    assert (total.n_emails, total.n_checked, total.n_reachable) == (400, 80, 40) and abs(total.n_domains - 50) <= 2 and total.n_companies == 7


def test_runs_leave_nothing_behind(spark):
    root = Folder(spark, work_dir(spark))
    before = set(root.names())
    with run(spark) as folder:
        inner = written(spark.range(5), "table")
        with run(spark):
            assert written(inner, "again").count() == 5
        assert Folder(spark, folder).names()
    assert set(root.names()) == before
    with pytest.raises(ValueError), run(spark):
        written(spark.range(5), "table")
        raise ValueError
    assert set(root.names()) == before and "run-" not in new_path(spark, "x")
    lost = Folder(spark, f"{work_dir(spark)}/run-lost")
    lost.create("started", "0")
    assert "run-lost" not in sweep_runs(spark, 1) and "run-lost" in sweep_runs(spark, -1)
