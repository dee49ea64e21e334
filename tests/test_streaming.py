"""Incremental runs equal one batch run."""

from contactloom import schema
from contactloom.operators import store
from contactloom.session import new_path
from contactloom.streaming import jobs

FOUND = "company_id bigint, email string, source string, method_ord int, seq bigint, confidence double"
AS_OF = "2024-01-01 00:00:00"


def test_two_arrivals_equal_one_batch(spark):
    first = [(1, "A@x.com", "static", 0, 1, 0.9), (1, "b@x.com", "static", 0, 2, 0.9), (1, "a@x.com", "static", 0, 3, 0.1)]
    second = [(1, "b@x.com ", "scraper", 1, 4, 0.5), (2, "b@x.com", "scraper", 1, 5, 0.5)]
    arriving, target, progress = (new_path(spark, n) for n in ("arriving", "store", "progress"))
    layout = spark.createDataFrame([], FOUND).schema
    for rows in (first, second):
        spark.createDataFrame(rows, layout).coalesce(1).write.mode("append").parquet(arriving)
        jobs.dedupe_into(jobs.file_stream(spark, arriving, layout), target, progress, ["method_ord", "seq"])
    batch = store.dedupe_first(spark.createDataFrame(first + second, layout), ["method_ord", "seq"])
    columns = ["company_id", "email", "source", "confidence"]
    got = jobs.store_contents(spark, target).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.select(*columns).collect()))
    jobs.dedupe_into(jobs.file_stream(spark, arriving, layout), target, new_path(spark, "again"), ["method_ord", "seq"])
    assert jobs.store_contents(spark, target).count() == len(got)


def test_enrichment(spark):
    rows = [(1, "A", "a.com"), (2, "B", "N/A"), (3, "C", "x y.z")]
    companies = spark.createDataFrame(rows, "id bigint, name string, website string")
    arriving = new_path(spark, "arriving")
    companies.write.parquet(arriving)

    def run(inline):
        target = new_path(spark, "store")
        stream = jobs.file_stream(spark, arriving, companies.schema)
        jobs.enrich_into(stream, target, new_path(spark, "progress"), AS_OF, inline)
        return sorted((r["company_id"], r["email"]) for r in jobs.store_contents(spark, target).collect())

    assert run(True) == [(1, e) for e in ("business@a.com", "contact@a.com", "hello@a.com", "info@a.com", "sales@a.com")]
    assert run(False) == [(1, "info@a.com"), (3, "info@xy.z")]


def test_pending_is_handed_out_once(spark):
    emails = schema.conform(
        spark.createDataFrame([(1, "a@x.com", None), (1, "b@x.com", 5)], "company_id bigint, email string, checked int"),
        schema.EMAILS,
    ).drop("checked")
    emails = emails.withColumn("checked_at", schema.instant(AS_OF)).filter("email = 'b@x.com'").unionByName(
        emails.filter("email = 'a@x.com'")
    )
    arriving, target, progress = (new_path(spark, n) for n in ("arriving", "store", "progress"))
    for _ in range(2):
        emails.write.mode("append").parquet(arriving)
        jobs.poll_into(jobs.file_stream(spark, arriving, emails.schema), target, progress)
    assert [r["email"] for r in jobs.store_contents(spark, target).collect()] == ["a@x.com"]


def test_state_bounded_option(spark):
    stream = jobs.file_stream(spark, "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema, "events.parquet")
    deduped = jobs.dedupe_within(
        stream.selectExpr("user_id AS company_id", "event_type AS email", "CAST(ts AS timestamp) AS ts"), "ts", "1 day"
    )
    assert deduped.isStreaming
