"""Behaviour beyond the fixtures: caps of every size, documents no parser likes, failed details, replies without order."""

import pytest
from pyspark.sql import functions as F

from contactloom import schema
from contactloom.functions.emails import emails_from_json
from contactloom.operators import rank, store
from contactloom.operators.queues import method_list
from contactloom.plans.check import ReplyLogChecker
from contactloom.sources import results


@pytest.mark.parametrize("n", [1, 1000, 1001, 5000])
@pytest.mark.parametrize("descending", [False, True])
def test_cap_of_every_size_and_direction(spark, n, descending):
    rows = [("hot", i % 3000 if i % 5 else None, i) for i in range(6000)] + [(None, 1, 7000), ("cold", 2, 8000)]
    table = spark.createDataFrame(rows, "k string, v int, id int")
    order = [F.desc("v"), F.desc("id")] if descending else ["v", "id"]
    got = {(r.k, r.id): r.pos for r in rank.top_n_per_group(table, ["k"], order, n, "pos").collect()}
    want = {}
    for key in ("hot", None, "cold"):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]), reverse=descending)
        want |= {(key, r[2]): i + 1 for i, r in enumerate(own[:n])}
    assert got == want


def test_documents_with_repeated_keys_and_large_strings(spark):
    bodies = ['{"a": 1, "a": "x@y.com"}', "p@q.com", '{"email": ["k@l.com"]', '["m@n.com"]']
    table = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    large = table.limit(1).select(F.lit(9).alias("id"), F.concat(F.lit('{"t": "'), F.repeat(F.lit("ab "), 6_000_000), F.lit('", "e": "big@y.com"}')).alias("body"))
    found = {tuple(r) for r in results.emails_from_results(table.unionByName(large), ["id"]).collect()}
    assert {(0, "x@y.com"), (3, "m@n.com"), (9, "big@y.com")} == found
    assert {r.id for r in results.rejected_results(table).collect()} == {1, 2}


def test_json_lists_are_read_whole(spark):
    texts = ["['a@b.com']", '["a@b.com"] junk', '["a@b.com"]]', '["a@b.com"], ["c@d.com"]', '["a@b.com"]', None, ""]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    got = table.select(emails_from_json(F.col("t")).alias("e"), method_list(F.col("t")).alias("m")).collect()
    assert [r.e for r in got] == [[], [], [], [], ["a@b.com"], [], []] and [r.m for r in got] == [r.e for r in got]


def test_a_reply_with_content_goes_before_an_empty_one(spark):
    emails = spark.createDataFrame([(1, "a@b.com")], "company_id long, email string")
    replies = spark.createDataFrame([(1, "a@b.com", ""), (1, "A@b.com", '{"is_reachable": "safe"}')], "company_id long, email string, reply string")
    (row,) = ReplyLogChecker().check(emails, replies).collect()
    assert row.is_reachable == "safe" and not row.is_error


def test_two_results_for_one_key_do_not_multiply(spark):
    emails = schema.conform(spark.createDataFrame([(1, "a@b.com")], "company_id long, email string"), schema.EMAILS)
    none = [F.lit(None).cast(schema.EMAILS[c].dataType).alias(c) for c in schema.CHECK_RESULTS]
    one = spark.createDataFrame([(1, "a@b.com", "late", True), (1, "a@b.com", None, False)], "company_id long, email string, check_error string, is_error boolean")
    done = store.apply_check_results(emails, one.select("*", *none), "2024-06-01 00:00:00", store.EMAIL_KEY).collect()
    assert len(done) == 1 and done[0].check_error is None
