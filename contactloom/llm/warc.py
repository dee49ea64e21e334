"""WARC archives as a Spark data source.

Every record is a gzip member of its own that names its compressed length in
the extra field ``sl``, so a reader that needs no more than the headers inflates
the beginning of a member and steps to the next. Files are partitions.
Predicates on record type and other header columns are pushed down and judged
on the parsed headers, before a payload is inflated.

Archives of other writers are read as a stream: members without a length or with
several records, and files that are not compressed, where unwanted blocks are
inflated piece by piece, or stepped over, and never held.
"""

from __future__ import annotations

import base64
import re
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

from contactloom.session import written

from .hot import join_counted

FORMAT = "warc"
SUFFIX, PLAIN = ".warc.gz", ".warc"
# Names of this writer's files: the write they belong to, then their own.
OWN_FILE = re.compile(r"part-([0-9a-f]{32})-[0-9a-f]{32}\.warc\.gz")
# A task starts another file beyond this size, so that readers get enough partitions.
FILE_BYTES = 64 << 20
READ_BYTES = 1 << 20
# Inflated at first, for the headers; more where they are longer.
HEAD_BYTES = 2048
MIN_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
COLUMNS = (
    "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
    "payload_length long, headers map<string,string>, payload binary"
)
# Columns that predicates may be judged on before the payload.
HEADER_COLUMNS = ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_length")
INPUT = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a URI, and the path in it. Without a scheme only Spark knows the store: see ``qualified``."""
    if "://" not in path and not path.startswith("file:"):
        raise ValueError(f"{path} names no store: use load and save_pages, or a path such as file:{path}")
    return pafs.FileSystem.from_uri(path.replace(" ", "%20"))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its store; one without a scheme lies in Spark's default store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


# ---- records


def member(raw: bytes) -> bytes:
    """One gzip member with its own length in the extra field ``sl`` (compressed and plain size)."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    """A response or revisit record. A revisit keeps the HTTP header, with the full length, but no payload."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    block = http + (payload if row["record_type"] == "response" else b"")
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {DATE}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_header_safe(row['target_uri'])}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _header_safe(value: str) -> str:
    """No line break or other control character gets into a header."""
    return urllib.parse.quote(value, safe="!#$%&'()*+,/:;=?@[]~|^`{}\\\"<>")


def parse_headers(head: bytes) -> dict[str, str]:
    """Names in lower case; values of a name that repeats are joined by a comma and a blank."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip().lower(), value.strip()
            out[name] = f"{out[name]}, {value}" if name in out else value
    return out


@dataclass
class Record:
    """Headers of the record and of its HTTP message, if it holds one; ``payload`` where it was asked for."""

    headers: dict[str, str]
    http: dict[str, str] | None
    payload: bytes | None = None

    @property
    def size(self) -> int:
        """Bytes of the block."""
        length = self.headers.get("content-length", "")
        return int(length) if length.isdigit() else 0

    def value(self, column: str):
        h = self.headers
        if column == "record_id":
            return h.get("warc-record-id", "").strip("<>")
        if column == "record_type":
            return h.get("warc-type")
        if column == "target_uri":
            return h.get("warc-target-uri")
        if column == "refers_to":
            return h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None
        if column == "payload_digest":
            name, _, digest = h.get("warc-payload-digest", "").partition(":")
            return _hex_digest(digest) if name.lower() == "sha1" and digest else None
        if self.http is None:
            return self.size
        length = self.http.get("content-length", "")
        return int(length) if length.isdigit() else None


def _hex_digest(digest: str) -> str | None:
    """SHA-1 in base 32 or in hex; None where it is neither."""
    try:
        return (bytes.fromhex(digest) if len(digest) == 40 else base64.b32decode(digest.upper())).hex()
    except ValueError:
        return None


class _Buffered:
    """Bytes of a file from any place on, read in large steps; skipping does not read."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.start, self.held = 0, b""

    def get(self, at: int, n: int) -> bytes:
        if at < self.start or at + n > self.start + len(self.held):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(max(n, READ_BYTES))
        return self.held[at - self.start : at - self.start + n]


class _Stream:
    """The bytes of a plain file, or of gzip members one after the other, read forwards. Holds what was looked at and not yet taken."""

    def __init__(self, source: _Buffered, at: int, plain: bool):
        self.source, self.at, self.plain = source, at, plain
        self.engine = None
        self.held = bytearray()

    def _more(self) -> bool:
        """Some more bytes into ``held``; False at the end."""
        if self.at >= self.source.size and not (self.engine and self.engine.unconsumed_tail):
            if self.engine is not None and not self.engine.eof:
                raise ValueError("the archive ends within a record")
            return False
        if self.plain:
            part = self.source.get(self.at, READ_BYTES)
            self.at += len(part)
            self.held += part
            return True
        if self.engine is None or self.engine.eof:
            self.engine = zlib.decompressobj(31)
        part = self.engine.unconsumed_tail
        if not part:
            part = self.source.get(self.at, READ_BYTES)
            self.at += len(part)
        self.held += self.engine.decompress(part, READ_BYTES)
        if self.engine.eof:
            self.at -= len(self.engine.unused_data)
        return True

    def until(self, mark: bytes) -> int:
        """Place of ``mark`` in the bytes ahead, -1 where the end comes first."""
        seen = 0
        while (found := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self._more():
                return -1
        return found

    def ahead(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        return bytes(self.held[:n])

    def skip(self, n: int) -> None:
        """A plain file is stepped over; a member is inflated and forgotten."""
        while n > len(self.held):
            n -= len(self.held)
            self.held.clear()
            if self.plain:
                self.at += n
                return
            if not self._more():
                return
        del self.held[:n]

    def take(self, n: int) -> bytes:
        out = self.ahead(n)
        self.skip(len(out))
        return out


def _http_end(block: bytes) -> int:
    """Where the payload begins in an HTTP message; -1 where the block is none, or its head is not complete yet."""
    if not block.startswith(b"HTTP/"):
        return -1
    end = block.find(b"\r\n\r\n")
    return end + 4 if end >= 0 else -1


def stream_records(source: _Buffered, at: int, plain: bool, wanted, with_payload: bool) -> Iterator[Record]:
    """All records from ``at`` to the end of the file."""
    stream = _Stream(source, at, plain)
    while True:
        while stream.ahead(2) in (b"\r\n", b"\n\n"):
            stream.skip(2)
        end = stream.until(b"\r\n\r\n")
        if end < 0:
            if stream.held.strip():
                raise ValueError("the archive ends within a record")
            return
        head = parse_headers(stream.take(end + 4))
        record = Record(head, None)
        n = HEAD_BYTES
        while True:
            block = stream.ahead(min(record.size, n))
            body = _http_end(block)
            if body >= 0 or len(block) == record.size or not block.startswith(b"HTTP/"):
                break
            n *= 4
        if body >= 0:
            record.http = parse_headers(block[:body])
        if not wanted(record):
            stream.skip(record.size)
            continue
        if with_payload:
            record.payload = stream.take(record.size)[max(0, body) :]
        else:
            stream.skip(record.size)
        yield record


def read_file(file, wanted, with_payload: bool, plain: bool = False) -> Iterator[Record]:
    """The records of one file. ``wanted`` judges a record by its headers; others are stepped over."""
    source, at = _Buffered(file), 0
    if plain:
        yield from stream_records(source, 0, True, wanted, with_payload)
        return
    while at < source.size:
        sizes = _member_sizes(source.get(at, 24))
        found = _sized_record(source, at, *sizes, wanted, with_payload) if sizes else None
        if found is None:
            # Not one record with its length: the rest is read as a stream.
            yield from stream_records(source, at, False, wanted, with_payload)
            return
        if found[0]:
            yield found[1]
        at += sizes[0]


def _sized_record(source: _Buffered, at: int, length: int, whole: int, wanted, with_payload: bool):
    """(wanted, record) of a member that holds ``whole`` bytes; None where that is not one record exactly."""
    n = HEAD_BYTES
    while True:
        head = _inflate(source.get(at, min(length, n)), n)
        end = head.find(b"\r\n\r\n")
        record = Record(parse_headers(head[:end]), None) if end >= 0 else None
        body = _http_end(head[end + 4 :]) if record else -1
        begun = b"HTTP/".startswith(head[end + 4 : end + 9]) if record else True
        if len(head) >= whole or body >= 0 or not begun or n > 1 << 30:
            break
        n *= 4
    if record is None or (end + 4 + record.size + 4) & 0xFFFFFFFF != whole:
        return None
    if body >= 0:
        record.http = parse_headers(head[end + 4 : end + 4 + body])
    if not wanted(record):
        return False, record
    if with_payload:
        raw = _inflate(source.get(at, length), 0)
        record.payload = raw[end + 4 + max(0, body) : end + 4 + record.size]
    return True, record


def _member_sizes(head: bytes) -> tuple[int, int] | None:
    """Compressed and plain length from the extra field; None where there is none."""
    if len(head) < 24 or head[:2] != b"\x1f\x8b" or not head[3] & 4 or head[12:14] != b"sl":
        return None
    sizes = struct.unpack("<II", head[16:24])
    return sizes if sizes[0] else None


def _inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj(31).decompress(data, most)


# ---- data source


@dataclass
class FilePartition(InputPartition):
    """A file by its place in the folder; None where there is none."""

    inside: str | None


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.with_payload = str(options.get("payload", "true")).lower() == "true"
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        """Takes equality and IN on header columns; Spark judges the rest."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in HEADER_COLUMNS and isinstance(f, EqualTo):
                self.tests.append((column, (f.value,)))
            elif column in HEADER_COLUMNS and isinstance(f, In):
                self.tests.append((column, tuple(f.value)))
            else:
                yield f

    def partitions(self):
        store, path = filesystem(self.path)
        if store.get_file_info(path).type == pafs.FileType.File:
            return [FilePartition("")]
        files = [i for i in store.get_file_info(pafs.FileSelector(path, recursive=True)) if i.type == pafs.FileType.File]
        # Of this writer's files those count that their write has listed, not those of lost attempts; others' files all do.
        committed: set[str] = set()
        for i in files:
            if i.base_name.startswith("_files-"):
                with store.open_input_stream(i.path, compression=None) as f:
                    committed |= {f"{i.path.rpartition('/')[0]}/{n}" for n in f.read().decode().split()}
        archives = [i.path for i in files if i.base_name.lower().endswith((SUFFIX, PLAIN)) and not i.base_name.startswith((".", "_"))]
        counted = [a for a in archives if not OWN_FILE.fullmatch(a.rpartition("/")[2]) or a in committed]
        root = path.rstrip("/")
        return [FilePartition(a[len(root) :]) for a in sorted(counted)] or [FilePartition(None)]

    def read(self, partition):
        if partition.inside is None:
            return
        store, path = filesystem(self.path.rstrip("/"))
        path += partition.inside
        tests, with_payload = self.tests, self.with_payload
        plain = path.lower().endswith(PLAIN)
        with store.open_input_file(path) as file:
            for r in read_file(file, lambda r: all(r.value(c) in values for c, values in tests), with_payload, plain):
                yield (*(r.value(c) for c in HEADER_COLUMNS), dict(r.headers), r.payload)


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files under names of its own; the commit lists those that count."""

    def __init__(self, path: str):
        self.path, self.name = path, uuid.uuid4().hex

    def write(self, iterator) -> Files:
        store, path = filesystem(self.path)
        store.create_dir(path, recursive=True)
        names: list[str] = []
        out = None
        held = 0
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    if out is None or held > FILE_BYTES:
                        if out is not None:
                            out.close()
                        names.append(f"part-{self.name}-{uuid.uuid4().hex}{SUFFIX}")
                        out, held = store.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                    data = member(record({c: batch.column(c)[i].as_py() for c in batch.schema.names}))
                    out.write(data)
                    held += len(data)
        finally:
            if out is not None:
                out.close()
        return Files(names)

    def commit(self, messages) -> None:
        store, path = filesystem(self.path)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/_files-{self.name}", compression=None) as f:
            f.write("\n".join(n for m in messages if m is not None for n in m.names).encode())

    def abort(self, messages) -> None:
        store, path = filesystem(self.path)
        for m in messages:
            for n in m.names if m is not None else ():
                store.delete_file(f"{path}/{n}")


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets it take predicates."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---- pages


def page_records(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """A record per row of ``pages`` (page_id, url, html), INPUT columns.

    Of rows with equal payloads of at least ``least`` bytes, the largest page_id
    is the response and the others revisit it; all smaller ones are responses.
    Rows that repeat the largest page_id are responses too. A null html is an
    empty payload, a null page_id the smallest of all. An empty table gives no
    records; other columns are left out. A very long html is one record.

    Digests are shuffled, pages are not where the digests that repeat are few;
    a digest of more than a thousandth of all rows is broadcast, so its pages stay where they are.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_length"))
    large = F.col("payload_length") >= least
    first = (
        rows.filter(large)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
    )
    met = join_counted(rows, written(first, "warc-first"), ["payload_digest"], "_n", "left")
    again = large & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return met.select(
        _urn(F.col("page_id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(again, _urn(F.col("_first"))).alias("refers_to"),
        "payload_digest",
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def _urn(page_id) -> F.Column:
    return F.concat(F.lit("urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")))


def page_of(urn) -> F.Column:
    return F.nullif(F.substring_index(urn, ":", -1), F.lit("")).cast("long")


def save_pages(pages: DataFrame, path: str) -> None:
    """Writes the pages as archives under ``path``."""
    register(pages.sparkSession)
    page_records(pages).write.format(FORMAT).mode("append").save(qualified(pages.sparkSession, path))


def load(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``, subfolders included; without ``payload`` that column is null and nothing is inflated for it.

    A revisit holds no payload, so it is empty; a record that is no HTTP message is payload as a whole.
    """
    register(spark)
    return spark.read.format(FORMAT).option("payload", str(payload).lower()).load(qualified(spark, path))


def page_payloads(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page record.

    Responses are inflated, and their lengths and digests taken from the
    payloads; revisits, which hold none, tell them in their headers, so for
    them nothing else is read. Each half pushes its record type down.
    """
    read = load(spark, path).filter(F.col("record_type") == "response")
    responses = read.select(
        page_of(F.col("record_id")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = load(spark, path, payload=False).filter(F.col("record_type") == "revisit")
    return responses.unionByName(
        revisits.select(
            page_of(F.col("record_id")).alias("page_id"),
            F.col("payload_length").alias("payload_bytes"),
            "payload_digest",
            "record_type",
            page_of(F.col("refers_to")).alias("refers_to"),
        )
    )


#: Digests and revisits by definition.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT html, max(page_id) AS first FROM p WHERE payload_bytes >= {MIN_REVISIT} GROUP BY html HAVING count(*) > 1)
SELECT page_id, payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""
