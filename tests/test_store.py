"""Merging, tracking, queues and reports on small fixtures."""

import pytest
from pyspark.sql import functions as F

from contactloom import schema
from contactloom.operators import queues, rank, reports, store
from contactloom.session import new_path
from contactloom.sources import results, sinks, tables

ORDER = ["method_ord", "seq"]
FOUND = "company_id bigint, email string, source string, method_ord int, seq bigint, confidence double"


def found(spark, rows):
    return spark.createDataFrame(rows, FOUND)


def test_insert_twice_adds_nothing(spark):
    path = new_path(spark, "emails")
    rows = found(spark, [(999, "A@x.com ", "static", 0, 0, 0.9), (999, "b@x.com", "static", 0, 1, 0.8)])
    assert sinks.insert_new_emails(rows, path, ORDER).count() == 2
    assert sinks.insert_new_emails(rows, path, ORDER).count() == 0
    stored = sinks.read_table(spark, path, schema.EMAILS)
    assert sorted(r["email"] for r in stored.collect()) == ["a@x.com", "b@x.com"]
    assert stored.filter("metadata IS NOT NULL OR checked_at IS NOT NULL").count() == 0


def test_large_batch_takes_the_shuffled_way(spark, monkeypatch):
    batch = found(spark, [(1, "a@x.com", "static", 0, 0, 0.9), (2, "a@x.com", "static", 0, 0, 0.9)])
    stored = found(spark, [(1, "a@x.com", "static", 0, 0, 0.9)])
    for bound in (0, 10):
        monkeypatch.setattr(store, "BROADCAST_ROWS", bound)
        assert [r["company_id"] for r in store.not_stored(batch, 2, stored).collect()] == [2]


def test_first_wins_ignores_confidence(spark):
    rows = found(
        spark,
        [(1, "A@x.com", "scraper", 1, 0, 0.99), (1, "a@x.com", "static", 0, 5, 0.1), (1, "a@x.com ", "static", 0, 2, 0.2)],
    )
    assert store.dedupe_first(rows, ORDER).first()["confidence"] == 0.2
    assert store.dedupe_first(rows, ORDER, keep="best").first()["confidence"] == 0.99


def test_metadata_is_json_or_null(spark):
    rows = spark.createDataFrame(
        [(1, "a@x.com", "s", 0, 0, {"k": "v"}), (1, "b@x.com", "s", 0, 1, {})],
        "company_id bigint, email string, source string, method_ord int, seq bigint, metadata map<string,string>",
    )
    added = store.new_email_rows(rows, schema.empty_table(spark, schema.EMAILS), ORDER).orderBy("email").collect()
    assert [r["metadata"] for r in added] == ['{"k":"v"}', None]
    assert added[0]["id"] != added[1]["id"]


def test_append_companies_keeps_repeats(spark):
    path = new_path(spark, "companies")
    row = spark.createDataFrame([("n", "a", "p", "w", "e", "q", 1)], [*schema.COMPANY_INSERT, "extra"])
    sinks.append_companies(row, path)
    sinks.append_companies(row, path)
    assert sinks.read_table(spark, path, schema.COMPANIES).count() == 2


def test_missing_columns_read_as_null(spark):
    path = new_path(spark, "old")
    spark.createDataFrame([(1, "n")], "id bigint, name string").write.parquet(path)
    row = sinks.read_table(spark, path, schema.COMPANIES).first()
    assert row["name"] == "n" and row["email_methods_used"] is None


def test_method_lists_stored_as_text(spark):
    raw = spark.createDataFrame([(1, '["static"]'), (2, "broken"), (3, None)], "id bigint, email_methods_used string")
    rows = schema.conform(raw, schema.COMPANIES).orderBy("id").collect()
    assert [r["email_methods_used"] for r in rows] == [["static"], None, None]


def test_result_and_line_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"emails": ["a@x.com"],\n "note": "b@x.com"}')
    (tmp_path / "b.json").write_text("broken c@x.com")
    (tmp_path / "lines.txt").write_text("A@x.com\r\n not one\n\nb@x.com")
    files = results.read_result_files(spark, f"{tmp_path}/*.json")
    assert sorted(r["email"] for r in results.emails_from_results(files, ["path"]).collect()) == ["a@x.com", "b@x.com"]
    lines = results.read_lines(spark, f"{tmp_path}/lines.txt")
    assert sorted(r["email"] for r in results.emails_from_lines(lines).collect()) == ["a@x.com", "b@x.com"]


def test_bucketed_store_is_not_shuffled(spark):
    emails = schema.conform(
        spark.range(100).select(F.col("id").alias("company_id"), F.concat("id", F.lit("@x.com")).alias("email")),
        schema.EMAILS,
    )
    table = sinks.save_bucketed(emails, "stored_bucketed", new_path(spark, "bucketed"), 8)
    batch = table.select("company_id", "email").limit(0).unionByName(
        spark.createDataFrame([(5, "5@x.com"), (5, "new@x.com")], "company_id bigint, email string")
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = batch.join(table.select("company_id", "email"), ["company_id", "email"], "left_anti")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        scan_side = plan[plan.rindex("FileScan") - 600 : plan.rindex("FileScan")]
        assert "Exchange" not in scan_side.split("SortMergeJoin")[-1].split("+- *")[-1]
        assert "Bucketed: true" in plan
        assert [r["email"] for r in joined.collect()] == ["new@x.com"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_check_results_overwrite_only_what_they_hold(spark):
    emails = schema.conform(
        spark.createDataFrame(
            [(1, "old", "safe"), (2, None, "safe"), (3, None, None)], "id bigint, check_error string, is_reachable string"
        ),
        schema.EMAILS,
    )
    results = schema.conform(
        spark.createDataFrame([(1, None, "risky", False), (2, "timeout", None, True)],
                              "id bigint, check_error string, is_reachable string, is_error boolean"),
        schema.EMAILS,
    )
    rows = store.apply_check_results(emails, results, "2024-01-01 00:00:00").orderBy("id").collect()
    assert [(r["is_reachable"], r["check_error"]) for r in rows] == [("risky", "old"), ("safe", "timeout"), (None, None)]
    assert [r["checked_at"] is not None for r in rows] == [True, True, False]


def test_method_tracking(spark):
    companies = schema.conform(
        spark.createDataFrame(
            [(1, ["static"], ["static"]), (2, None, None), (3, ["x"], None)],
            "id bigint, email_methods_used array<string>, email_methods_completed array<string>",
        ),
        schema.COMPANIES,
    )
    runs = spark.createDataFrame(
        [(1, "scraper", False, 3), (1, "static", True, 1), (1, "scraper", True, 9), (1, "harvester", True, 5),
         (2, "static", False, 1), (77, "static", True, 1)],
        "company_id bigint, method string, completed boolean, run_no int",
    )
    rows = store.update_methods(companies, runs, "2024-01-01 00:00:00").orderBy("id").collect()
    assert rows[0]["email_methods_used"] == ["static", "scraper", "harvester"]
    assert rows[0]["email_methods_completed"] == ["static", "harvester", "scraper"]
    assert rows[1]["email_methods_used"] == ["static"] and rows[1]["email_methods_completed"] == []
    assert rows[2]["email_methods_used"] == ["x"] and rows[2]["last_email_scan"] is None
    assert len(rows) == 3


QUEUE = [
    (1, "a.com", None), (2, "", None), (3, None, None), (4, "N/A", None), (5, "x N/a y", None), (6, "n", None),
    (7, "b.com", '["STATIC"]'), (8, "c.com", "[]"), (9, "d.com", "broken"), (10, "e.com", '["scraper"]'),
]


def test_queues(spark):
    raw = spark.createDataFrame(QUEUE, "id bigint, website string, done string").withColumn("name", F.lit("n"))
    c = raw.withColumn("email_methods_completed", queues.method_list(F.col("done")))

    def ids(df):
        return [r["id"] for r in df.collect()]

    assert ids(queues.bulk_queue(c, "static")) == [1, 8, 9, 10]
    assert ids(queues.bulk_queue(c, "static", limit=2, offset=1)) == [8, 9]
    assert ids(queues.bulk_queue(c, "static", limit=0)) == [1, 8, 9, 10]
    assert ids(queues.needing_method(c, "static")) == [1, 4, 5, 6, 8, 9, 10]
    assert set(ids(queues.bulk_queue(c, "static"))) <= set(ids(queues.needing_method(c, "static")))
    both = queues.needing_any_method(c, ["static", "scraper"], limit=3).collect()
    assert sorted((r["needed_method"], r["id"]) for r in both) == [
        ("scraper", 1), ("scraper", 4), ("scraper", 5), ("static", 1), ("static", 4), ("static", 5),
    ]
    assert [r["id"] for r in queues.with_valid_domain(c).orderBy("id").collect()] == [1, 7, 8, 9, 10]
    assert queues.with_valid_domain(c, clean=False).count() == 8
    assert queues.with_domain(c).count() == 5
    assert queues.with_domain(c, skip_invalid=False).count() == 8


def test_expansion(spark):
    templates = spark.createDataFrame(
        [("a in ${country}",), ("b in ${state}",), ("c ${state} ${country}",), ("d",)], "template string"
    )
    got = tables.expand_queries(templates, tables.config_list("X, Y"), ["S"]).select("query")
    assert sorted(r[0] for r in got.collect()) == ["a in X", "a in Y", "b in S", "c ${state} X", "c ${state} Y", "d"]


def test_settings_are_refused_not_cut(spark):
    with pytest.raises(ValueError):
        tables.settings_values(spark.range(11).withColumn("v", F.col("id").cast("string")), "v", most=10)


def test_runs_to_expire(spark):
    names = ["2024-01-01_000000", "2024-01-02_000000", "2024-01-03_000000", "other", "2024-02-30_000000"]
    manifest = spark.createDataFrame(
        [(f"p{i}", n, i) for i, n in enumerate(names)], "path string, run_name string, created_at int"
    )
    assert [r["path"] for r in reports.runs_to_expire(manifest, 2).collect()] == ["p0"]


def test_domain_reports(spark):
    domains = spark.createDataFrame([("a.com",), ("b.com",), ("b.com",)], "domain string")
    mails = spark.createDataFrame(
        [("a.com", "x@a.com"), ("a.com", "x@a.com"), ("a.com", "y@b.com"), ("c.com", "z@c.com")], "domain string, email string"
    )
    sizes = reports.found_per_domain(domains, mails)
    assert reports.domain_summary(sizes).first().asDict() == {
        "total_domains": 2, "domains_with_emails": 1, "total_emails": 2, "success_rate": 50.0,
    }
    assert [tuple(r) for r in reports.top_domains(sizes).collect()] == [("a.com", 2)]
    empty = reports.domain_summary(sizes.limit(0)).first()
    assert (empty["total_domains"], empty["total_emails"], empty["success_rate"]) == (0, 0, 0.0)


def test_unchecked_limit_and_source(spark):
    emails = spark.createDataFrame(
        [(1, "static", 5, None), (2, "scraper", 4, None), (3, "static", 4, None), (4, "static", 1, 9)],
        "id bigint, source string, created_at int, checked_at int",
    )
    assert [r["id"] for r in queues.unchecked(emails).collect()] == [2, 3, 1]
    assert [r["id"] for r in queues.budget(emails, 2).collect()] == [2, 3]
    assert [r["id"] for r in queues.unchecked(emails, source="static").collect()] == [3, 1]
    assert rank.batches(emails, ["created_at", "id"], 3).filter("batch_no = 1").count() == 1
