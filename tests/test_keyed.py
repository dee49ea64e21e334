"""The keyed table: small writes, single commits, replays, competing writers, compaction, clean-up."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactloom import schema
from contactloom.operators import checks, store
from contactloom.session import new_path
from contactloom.sources import sinks
from contactloom.sources.files import Folder
from contactloom.sources.keyed import STATE_EVERY, KeyedTable
from contactloom.streaming import jobs
from contactloom.streaming.leases import Leases

AS_OF = "2024-06-01 00:00:00"
LAYOUT = T.StructType([T.StructField("k", T.LongType()), T.StructField("e", T.StringType()), T.StructField("v", T.LongType())])


def table(spark, buckets=4, path=None):
    return KeyedTable(spark, path or new_path(spark, "keyed"), LAYOUT, ["k", "e"], buckets)


def rows(spark, begin, end, v=0):
    return spark.range(begin, end).select(F.col("id").alias("k"), F.concat(F.lit("e"), "id").alias("e"), F.lit(v).cast("long").alias("v"))


def contents(t):
    return {r.k: r.v for r in t.rows().collect()}


def test_insert_ignores_what_is_stored(spark):
    t = table(spark)
    assert t.rows().count() == 0 and t.insert(rows(spark, 0, 0)).count() == 0 and t.state().version == 0
    assert t.insert(rows(spark, 0, 100, 1)).count() == 100
    assert sorted(r.k for r in t.insert(rows(spark, 50, 120, 2)).collect()) == list(range(100, 120))
    assert contents(t) == {k: 1 if k < 100 else 2 for k in range(120)}
    null = spark.createDataFrame([(None, "x", 1), (1, None, 1)], LAYOUT)
    t.insert(null)
    assert t.rows().count() == 122


def test_a_batch_counts_once(spark):
    t = table(spark)
    t.insert(rows(spark, 0, 10, 1), "s", 0)
    assert t.insert(rows(spark, 0, 20, 2), "s", 0).count() == 0 and len(contents(t)) == 10
    assert t.insert(rows(spark, 0, 20, 2), "s", 1).count() == 10
    assert t.insert(rows(spark, 20, 21), "other", 0).count() == 1
    t.update(rows(spark, 0, 5), lambda r: r.withColumn("v", r.v + 1), "u", 7)
    t.update(rows(spark, 0, 5), lambda r: r.withColumn("v", r.v + 1), "u", 7)
    assert contents(t)[0] == 2


def test_a_write_that_was_not_committed_does_not_count(spark, monkeypatch):
    t = table(spark)
    t.insert(rows(spark, 0, 10, 1))

    def dies(self, state, entry):
        raise OSError("the writer is lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", dies)
        with pytest.raises(OSError):
            t.insert(rows(spark, 5, 30, 2), "s", 0)
    assert len(contents(t)) == 10
    assert t.insert(rows(spark, 5, 30, 2), "s", 0).count() == 20 and t.rows().count() == 30
    assert len(t.sweep(0)) == 2 and t.rows().count() == 30


def test_of_two_writers_the_second_judges_again(spark, monkeypatch):
    path = new_path(spark, "keyed")
    first, second = table(spark, path=path), table(spark, path=path)
    commit, met = KeyedTable._commit, []

    def late(self, state, entry):
        if self is first and not met:
            met.append(second.insert(rows(spark, 5, 15, 2)).count())
        return commit(self, state, entry)

    monkeypatch.setattr(KeyedTable, "_commit", late)
    assert sorted(r.k for r in first.insert(rows(spark, 0, 10, 1)).collect()) == [0, 1, 2, 3, 4]
    assert met == [10] and contents(first) == {k: 1 if k < 5 else 2 for k in range(15)}
    met.clear()

    def late_update(self, state, entry):
        if self is first and not met:
            met.append(second.update(rows(spark, 0, 1), lambda r: r.withColumn("v", r.v + 100)).count())
        return commit(self, state, entry)

    monkeypatch.setattr(KeyedTable, "_commit", late_update)
    first.update(rows(spark, 0, 2), lambda r: r.withColumn("v", r.v + 10))
    assert contents(first)[0] == 111 and contents(first)[1] == 11


def test_updates_write_little_and_the_latest_counts(spark):
    t = table(spark, 8)
    t.insert(rows(spark, 0, 20_000, 1))
    data = Folder(spark, f"{t.path}/data")
    before = data.n_bytes()
    assert t.update(rows(spark, 100, 120), lambda r: r.withColumn("v", r.v + 1)).count() == 20
    assert data.n_bytes() - before < 0.08 * before  # headers of eight small files
    t.update(rows(spark, 110, 130), lambda r: r.withColumn("v", r.v + 1))
    assert t.update(rows(spark, 30_000, 30_010), lambda r: r).count() == 0
    want = {k: 1 + (100 <= k < 120) + (110 <= k < 130) for k in range(20_000)}
    assert contents(t) == want
    added, changed = t.put(rows(spark, 19_990, 20_010, 9), lambda r: r.withColumn("v", F.lit(5).cast("long")))
    assert added.count() == 10 and changed.count() == 10
    want |= {k: 5 for k in range(19_990, 20_000)} | {k: 9 for k in range(20_000, 20_010)}
    assert contents(t) == want
    kept = t.state().adds["3"]
    assert t.compact(["0", "1"]) == ["0", "1"] and contents(t) == want and t.state().adds["3"] == kept
    assert "0" not in t.state().changes and "3" in t.state().changes
    t.compact([str(b) for b in range(8)])
    assert t.due() == [] and contents(t) == want and not t.state().changes
    assert t.sweep(0) and contents(t) == want and t.sweep(24) == []


def test_a_small_batch_opens_few_buckets(spark):
    t = table(spark, 16)
    t.insert(rows(spark, 0, 30_000))
    assert len(t.may_hold(rows(spark, 7, 8), t.state())) == 1
    unknown = t.may_hold(rows(spark, 50_000, 50_016), t.state())
    assert len(unknown) <= 2
    every = t.may_hold(rows(spark, 0, 3000), t.state())
    assert len(every) == 16
    state = t.state()
    plan = t._read(t.may_hold(rows(spark, 7, 8), state), None)._jdf.queryExecution().executedPlan().toString()
    assert "paths" in plan or "Location" in plan
    assert len(t._read(t.may_hold(rows(spark, 7, 8), state), None).inputFiles()) < len(t.rows(state).inputFiles()) / 8


def test_buckets_that_are_due_and_states_written_down(spark):
    t = table(spark, 1)
    for i in range(STATE_EVERY + 2):
        t.insert(rows(spark, i, i + 1))
    assert any(n.startswith("state-") for n in t.log.names())
    assert t.due() == ["0"] and t.compact() == ["0"] and len(contents(t)) == STATE_EVERY + 2
    again = KeyedTable(spark, t.path, LAYOUT, ["k", "e"], 99)
    assert again.buckets == 1 and len(contents(again)) == STATE_EVERY + 2
    with pytest.raises(ValueError):
        KeyedTable(spark, t.path, LAYOUT, ["k"], 1)


def test_a_name_is_created_once(spark):
    folder = Folder(spark, new_path(spark, "files"))
    assert folder.names() == [] and folder.create("a", "1") and not folder.create("a", "2") and folder.read("a") == "1"
    assert [n for n in folder.names() if not n.startswith(".")] == ["a"]


EMAIL = "company_id long, email string, source string, checked_at timestamp_ntz, created_at timestamp_ntz, id long"


def snapshot(spark, *checked):
    base = spark.createDataFrame([(i, f"a{i}@x.com", "static", None, None, i) for i in range(6)], EMAIL)
    return base.withColumn("checked_at", F.when(F.col("id").isin(*checked), schema.instant(AS_OF)) if checked else F.col("checked_at"))


def test_leases(spark):
    leases = Leases(spark, new_path(spark, "leases"), 2)
    leases.arrive(snapshot(spark, 5), "in", 0)
    hand = lambda now, *a, **k: sorted(r.id for r in leases.hand_out(now, 60, *a, **k).collect())
    assert hand("2024-01-01 00:00:00", 3) == [0, 1, 2]
    assert hand("2024-01-01 00:00:30") == [3, 4]
    assert hand("2024-01-01 00:00:59") == []
    # A lost check: 0 is open after its lease; 1 and 2 were checked; 3 and 4 are still leased.
    leases.arrive(snapshot(spark, 1, 2, 5), "in", 1)
    assert hand("2024-01-01 00:01:00", name="poll", batch=0) == [0]
    assert hand("2024-01-01 00:09:00", name="poll", batch=0) == [0]  # the replayed round
    assert hand("2024-01-01 00:01:30", name="poll", batch=1) == [3, 4]
    found = {r.id: (r.attempts, r.checked_at is None) for r in leases.table.rows().collect()}
    assert found == {0: (2, True), 1: (1, False), 2: (1, False), 3: (2, True), 4: (2, True), 5: (0, False)}
    # An open row of a later snapshot does not take a check back.
    leases.arrive(snapshot(spark), "in", 2)
    assert leases.table.rows().filter("checked_at is null").count() == 3


def test_a_killed_batch_is_replayed(spark, monkeypatch):
    layout = spark.createDataFrame([], "company_id bigint, email string, source string, method_ord int, seq bigint, confidence double").schema
    arriving, target, progress = (new_path(spark, n) for n in ("arriving", "store", "progress"))
    spark.createDataFrame([(1, f"a{i}@x.com", "static", 0, i, 0.9) for i in range(4)], layout).write.parquet(arriving)
    insert, calls = jobs.insert_found, []

    def dies_after_commit(*args):
        insert(*args)
        calls.append(1)
        if len(calls) == 1:
            raise OSError("killed between commit and progress")

    monkeypatch.setattr(jobs, "insert_found", dies_after_commit)
    stream = lambda: jobs.file_stream(spark, arriving, layout)
    with pytest.raises(Exception, match="killed"):
        jobs.dedupe_into(stream(), target, progress, ["method_ord", "seq"])
    jobs.dedupe_into(stream(), target, progress, ["method_ord", "seq"])
    assert len(calls) == 2 and jobs.store_contents(spark, target).count() == 4
    assert sinks.email_table(spark, target).state().version == 1


def test_check_results_equal_the_snapshot(spark):
    emails = schema.conform(snapshot(spark), schema.EMAILS).select(*schema.EMAILS.fieldNames())
    replies = spark.createDataFrame([(0, "A0@x.com", ""), (3, "a3@x.com", '{"is_reachable": "safe"}')], "company_id long, email string, reply string")
    flat = checks.flatten_replies(replies.withColumn("email", F.lower("email")))
    t = sinks.email_table(spark, new_path(spark, "emails"), 2)
    t.insert(emails)
    assert sinks.save_check_results(t, flat, AS_OF).count() == 2
    want = store.apply_check_results(emails, flat, AS_OF, store.EMAIL_KEY)
    assert sorted(map(str, t.rows().collect())) == sorted(map(str, want.select(*t.rows().columns).collect()))
