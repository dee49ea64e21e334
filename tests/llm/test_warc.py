"""Archives of this writer and of others: nothing is lost, unwanted payloads are not inflated."""

import gzip
import hashlib

import zlib

import pytest

from contactloom.llm import warc
from contactloom.session import new_path


def foreign(kind, block, *more, record_id="urn:x:1"):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
RECORDS = [
    foreign("warcinfo", b"software: x\r\n", record_id="urn:x:0"),
    foreign("response", HTTP, "WARC-Concurrent-To: <a>", "WARC-Concurrent-To: <b>"),
    foreign("resource", b"hello", record_id="urn:x:2"),
    foreign("response", b"HTTP/1.0 200 OK\r\nX: " + b"y" * 9000 + b"\r\n\r\n" + b"z" * 3_000_000, record_id="urn:x:3"),
    foreign("metadata", b"", record_id="urn:x:4"),
]
PAYLOADS = {"urn:x:0": b"software: x\r\n", "urn:x:1": b"hello", "urn:x:2": b"hello", "urn:x:3": b"z" * 3_000_000, "urn:x:4": b""}


def layouts():
    whole = b"".join(RECORDS)
    return {
        "one member.warc.gz": gzip.compress(whole),
        "members.warc.gz": b"".join(gzip.compress(r) for r in RECORDS),
        "sized.warc.gz": b"".join(warc.member(r) for r in RECORDS),
        "sized but together.warc.gz": warc.member(RECORDS[0] + RECORDS[1]) + warc.member(b"".join(RECORDS[2:])),
        "mixed.warc.gz": warc.member(RECORDS[0]) + gzip.compress(RECORDS[1] + RECORDS[2]) + warc.member(RECORDS[3]) + warc.member(RECORDS[4]),
        "plain.warc": whole,
    }


@pytest.mark.parametrize("name", list(layouts()))
def test_every_record_of_every_layout(spark, tmp_path, name):
    (tmp_path / "sub folder").mkdir()
    (tmp_path / "sub folder" / name).write_bytes(layouts()[name])
    path = f"file:{tmp_path}"
    got = {r.record_id: r for r in warc.load(spark, path).collect()}
    assert {k: bytes(r.payload) for k, r in got.items()} == PAYLOADS
    assert got["urn:x:1"].headers["warc-concurrent-to"] == "<a>, <b>"
    assert got["urn:x:2"].payload_length == 5 and got["urn:x:3"].payload_length is None
    only = warc.load(spark, path, payload=False).filter("record_type = 'response'").collect()
    assert sorted(r.record_id for r in only) == ["urn:x:1", "urn:x:3"] and only[0].payload is None


def test_foreign_archives_beside_own_ones(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string")
    path = f"file:{tmp_path}/w"
    warc.save_pages(pages, path)
    (tmp_path / "w" / "other.warc.gz").write_bytes(gzip.compress(RECORDS[1]))
    lost = f"part-{'0' * 32}-{'1' * 32}.warc.gz"
    (tmp_path / "w" / lost).write_bytes(warc.member(RECORDS[2]))
    assert sorted(r.record_id for r in warc.load(spark, path).collect()) == ["urn:x-page:1", "urn:x-page:2", "urn:x:1"]
    warc.save_pages(pages.limit(1), path)
    assert warc.load(spark, path).count() == 4


def test_a_path_without_a_scheme_lies_in_the_default_store(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(RECORDS[1])
    assert warc.load(spark, str(tmp_path)).count() == 1 and warc.qualified(spark, str(tmp_path)).startswith("file:/")
    with pytest.raises(ValueError):
        warc.filesystem(str(tmp_path))


@pytest.mark.parametrize("data, plain", [(b"WARC/1.0\r\nWARC-Type: x", True), (gzip.compress(RECORDS[1])[:-20], False)])
def test_archives_that_end_within_a_record(tmp_path, data, plain):
    import pyarrow as pa

    with pytest.raises((ValueError, zlib.error)):
        list(warc.read_file(pa.BufferReader(data), lambda r: True, True, plain))


def test_unwanted_payloads_are_not_inflated(monkeypatch):
    import pyarrow as pa

    whole = []
    inflate = warc._inflate
    monkeypatch.setattr(warc, "_inflate", lambda data, most: whole.append(most) or inflate(data, most))
    file = pa.BufferReader(layouts()["sized.warc.gz"])
    found = list(warc.read_file(file, lambda r: r.value("record_type") == "resource", True))
    assert [r.payload for r in found] == [b"hello"] and whole.count(0) == 1


def test_digests_are_those_of_the_payloads(spark):
    large = "x" * 2000
    pages = spark.createDataFrame([(1, "u", large), (2, "u", large), (3, "u", None), (2, "v", large)], "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.save_pages(pages, path)
    sha = hashlib.sha1(large.encode()).hexdigest()
    want = [(1, 2000, sha, "revisit", 2), (2, 2000, sha, "response", None), (2, 2000, sha, "response", None), (3, 0, hashlib.sha1(b"").hexdigest(), "response", None)]
    assert sorted(map(tuple, warc.page_payloads(spark, path).collect())) == want
    # A payload that was spoilt after writing shows, whatever its header says.
    folder = path.removeprefix("file:")
    import glob

    for name in glob.glob(f"{folder}/*.warc.gz"):
        data = gzip.open(name).read()
        with open(name, "wb") as f:
            f.write(b"".join(warc.member(b"WARC/1.1" + r.replace(b"xxxx", b"yyyy")) for r in data.split(b"WARC/1.1")[1:]))
    found = {r.page_id: r.payload_digest for r in warc.page_payloads(spark, path).collect()}
    assert found[2] == hashlib.sha1(b"y" * 2000).hexdigest()


def test_odd_pages(spark):
    rows = [(1, None, "é" * 2_000_000, 1, "x"), (1, "u", "é" * 2_000_000, 2, None), (None, "u", "", 3, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int, record_type string")
    path = new_path(spark, "warc")
    warc.save_pages(pages, path)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type) for r in warc.page_payloads(spark, path).collect()), key=str)
    assert got == [(1, 4_000_000, "response"), (1, 4_000_000, "response"), (None, 0, "response")]
    empty = new_path(spark, "warc")
    warc.save_pages(pages.limit(0), empty)
    assert warc.page_payloads(spark, empty).count() == 0
