"""Operators that compare rows: brute force on skewed and odd tables, SQL, round trips."""

import glob
import gzip
import random

import pytest
from pyspark.sql import functions as F

from contactloom.llm import jaccard_join, line_spread, sharding, suffix_dedup, warc
from contactloom.llm.components import components
from contactloom.llm.registered import ORACLES, QUERIES
from contactloom.session import new_path

from ..oracle import compare, connect
from . import brute

DOCS = "doc_id long, text string, source string, component_id double"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", 0.5) if len(r) == 2 else (*r, 0.5) for r in rows], DOCS)


def prose(rng, n, words="abcdefghij"):
    return " ".join("".join(rng.choice(words) for _ in range(4)) for _ in range(n))


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), sf_dir, name, QUERIES[name], ORACLES[name]) is None


def near_copies(rng):
    """Groups of copies, near copies with chains, a passage in many texts, and odd rows."""
    text = prose(rng, 120)
    rows = [text] * 12
    for _ in range(30):
        words = text.split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "edit%d" % rng.randrange(99)
        rows.append(" ".join(words))
    shared = prose(rng, 60)
    rows += [prose(rng, 40) + " " + shared + " " + prose(rng, 40) for _ in range(20)]
    rows += [None, "", " \n", "One", "one", "one two", "ONE  two", prose(rng, 20_000)]
    return rows


@pytest.mark.parametrize("region", [256, 4])
def test_jaccard_join(spark, monkeypatch, region):
    monkeypatch.setattr(jaccard_join, "REGION", region)
    rows = list(enumerate(near_copies(random.Random(2))))
    rows += [rows[3], (None, "lonely text of no id"), (-5, rows[0][1]), (7, "another text under an id that is there")]
    got = [tuple(r) for r in jaccard_join.join_documents(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(brute.jaccard_components(rows), key=str)


def test_jaccard_chance_islands_are_cut(spark, monkeypatch):
    """Short texts that share common triples only are no island when they come to be compared."""
    monkeypatch.setattr(jaccard_join, "REGION", 8)
    monkeypatch.setattr(jaccard_join, "CUT", 32, raising=False)
    rng, largest, links = random.Random(5), [], jaccard_join._links

    def seen(members):
        largest.append(members.agg(F.max("size")).first()[0])
        return links(members)

    monkeypatch.setattr(jaccard_join, "_links", seen)
    common = ["of", "the", "in"]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.6 else "w%d" % rng.randrange(10**6) for _ in range(24)) for _ in range(800)]
    chain = [prose(rng, 100).split()]
    for _ in range(59):  # each linked with the one before, the ends are far apart
        chain.append([*chain[-1]])
        chain[-1][len(chain) % 100] = "edit%d" % len(chain)
    rows = list(enumerate([*texts, *(t + " end" for t in texts[:20]), *map(" ".join, chain)]))
    rng.shuffle(rows)
    got = [tuple(r) for r in jaccard_join.join_documents(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(brute.jaccard_components(rows), key=str)
    assert largest == [60]  # the chain


def test_jaccard_empty_and_keep_one(spark):
    assert jaccard_join.join_documents(docs(spark, [])).count() == 0
    text = prose(random.Random(1), 30)
    kept = jaccard_join.keep_one(docs(spark, [(4, text), (2, text), (9, "else"), (None, "no id"), (3, None)]))
    assert sorted(kept.collect(), key=str) == sorted(docs(spark, [(2, text), (9, "else"), (None, "no id"), (3, None)]).collect(), key=str)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(9)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 109)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("task_bytes, batch", [(4 << 20, 1 << 18), (1000, 1000)])
def test_suffix_dedup(spark, monkeypatch, task_bytes, batch):
    monkeypatch.setattr(suffix_dedup, "TASK_BYTES", task_bytes)
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    rng = random.Random(4)
    part = prose(rng, 130)
    texts = [prose(rng, rng.randrange(90)) + part[rng.randrange(60) : -1 - rng.randrange(60)] + prose(rng, 50) for _ in range(25)]
    texts += [part + " é " + part, "x" * 1500, "ab" * 450, part[:400], part[:399], texts[0], texts[0], None, "", "short", "short"]
    got = suffix_dedup.remove_repeats(docs(spark, list(enumerate(texts))), with_kept=True).orderBy("doc_id").collect()
    assert [tuple(r[1:5]) for r in got] == brute.repeats_removed(texts)
    assert all(brute.sha(bytes(r.kept)) == r.kept_sha256 for r in got)
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_suffix_dedup_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = QUERIES["op7_suffix_dedup"](spark, sf_dir).orderBy("doc_id").collect()
    assert [tuple(r[1:]) for r in got] == brute.repeats_removed([r.text for r in rows])


def test_jaccard_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op8_jaccard_join"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(brute.jaccard_components(rows))


def test_suffix_contexts_one_worker_per_task(spark):
    part = prose(random.Random(11), 120)
    texts = docs(spark, [(i, part) for i in range(6)] + [(6, "short"), (7, part + " é")]).selectExpr("unhex(md5(text)) AS key", "text").coalesce(1)
    rows = suffix_dedup._context_rows(texts)
    # A second step in Python would be a second worker for each task, kept by the executor.
    assert rows._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
    assert len(set(rows.select("key", "first").collect())) == rows.count() > 0
    assert rows.select("key").distinct().count() == 2


def test_long_pieces_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP", 700)
    part = prose(random.Random(8), 200)
    texts = [part + prose(random.Random(9), 900) + part, prose(random.Random(10), 300) + part[100:800]]
    got = suffix_dedup.remove_repeats(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [tuple(r[1:]) for r in got] == brute.repeats_removed(texts)


def test_line_spread(spark):
    common = "all rights are reserved"
    rows = [(i, f"own line number {i}\n {common}\t\nshort", f"s{i % 12}") for i in range(30)]
    rows += [(40, f"{common}\nrare line of three", None), (41, None, "s1"), (42, "", "s2"), (0, rows[0][1], "s0"), (None, common, "s5")]
    got = {(r.doc_id, r.text): (r.n_lines, r.n_removed) for r in line_spread.remove_lines(docs(spark, rows)).collect()}
    assert got[0, rows[0][1]] == (3, 0)
    assert all(got[i, f"own line number {i}\nshort"] == (3, 1) for i in range(1, 30))
    assert got[40, "rare line of three"] == (2, 1) and got[41, None] == (0, 0) and got[42, ""] == (1, 0) and got[None, ""] == (1, 1)
    assert line_spread.remove_lines(docs(spark, [])).count() == 0
    few = line_spread.remove_lines(docs(spark, rows), sites=13)
    assert few.filter("n_removed > 0").count() == 0


def test_sharding_broadcasts_no_prefixes(spark, monkeypatch):
    """Tables of prefixes are small files but large in the driver: no join may collect them there."""
    plans, write = [], sharding.written

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(sharding, "written", seen)
    table = spark.range(3000).selectExpr("id as doc_id", "id % 7 as n_bytes")
    out = sharding.assign_shards(table, limit=100)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)
    # Each row in the shallowest bucket that needs no split, by the definition.
    hashes = {r.doc_id: (r.h, r.n_bytes) for r in table.withColumn("h", sharding.key_hash(F.col("doc_id"))).collect()}
    sums = {}
    for h, n in hashes.values():
        for d in range(40):
            size, count = sums.get((d, h >> (60 - d)), (0, 0))
            sums[d, h >> (60 - d)] = size + n, count + 1
    rows = out.collect()
    assert len(rows) == 3000
    for r in rows:
        own = [(d, hashes[r.doc_id][0] >> (60 - d)) for d in range(40)]
        first = next(b for b in own if sums[b][0] <= 100 or sums[b][1] == 1)
        assert (r.depth, r.bucket, r.shard_bytes, r.shard_rows, r.family) == (*first, *sums[first], None)


def test_sharding(spark, tmp_path):
    rows = [(i, 10) for i in range(500)] + [(7, 3)] * 400 + [(900, 5000), (None, 5), (901, None)]
    table = spark.createDataFrame(rows, "doc_id long, n_bytes long")
    got = sharding.assign_shards(table, limit=100).collect()
    assert sorted(((r.doc_id, r.n_bytes) for r in got), key=str) == sorted(rows, key=str)
    shards = {}
    for r in got:
        shards.setdefault((r.family, r.depth, r.bucket), []).append(r)
    for group in shards.values():
        size = sum(r.n_bytes or 0 for r in group)
        assert all(r.shard_bytes == size and r.shard_rows == len(group) for r in group)
        assert size <= 100 or len(group) == 1
    assert any(family is not None for family, _, _ in shards)
    assert sharding.assign_shards(table.limit(0), limit=100).count() == 0
    sharding.write_shards(table, str(tmp_path / "shards"), limit=1000)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)


def test_warc_round_trip(spark):
    large = "<p>" + "é" * 800
    rows = [(1, "http://a/", large), (9, "http://b/\r\nX: y", large), (3, None, large), (9, "http://b/2", large), (4, "u", None), (5, "u", "small"), (6, "u", "small"), (None, "u", large)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = new_path(spark, "test-warc")
    warc.save_pages(pages, path)
    got = {(r.record_id, r.target_uri): r for r in warc.load(spark, path).collect()}
    assert len(got) == len(rows)
    assert sorted(r.record_type for r in got.values()) == ["response"] * 5 + ["revisit"] * 3
    assert {r.refers_to for r in got.values() if r.record_type == "revisit"} == {"urn:x-page:9"}
    first = next(r for r in got.values() if r.record_id == "urn:x-page:9")
    assert bytes(first.payload).decode() == large and first.payload_length == len(large.encode())
    only = warc.load(spark, path).filter("record_type = 'revisit'")
    assert only.count() == 3 and only.filter("record_id in ('urn:x-page:1', 'urn:x-page:3')").count() == 2
    assert warc.load(spark, path, payload=False).filter("payload is not null").count() == 0
    # Any gzip reader gets the same bytes, and members without a length are read too.
    folder = path.removeprefix("file:")
    plain = b"".join(gzip.open(f).read() for f in glob.glob(f"{folder}/*.warc.gz"))
    other = new_path(spark, "other-warc")
    import os

    os.makedirs(other)
    with gzip.open(f"{other}/a.warc.gz", "wb") as f:
        f.write(plain[: plain.index(b"WARC/1.1", 10)])
    assert warc.load(spark, other).count() == 1
    empty = new_path(spark, "empty-warc")
    warc.save_pages(pages.limit(0), empty)
    assert warc.load(spark, empty).count() == 0
