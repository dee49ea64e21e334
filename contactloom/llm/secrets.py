"""Secret scans: Aho-Corasick keyword prefilter, anchored patterns near hits, checksums inside.

One automaton over all keywords runs once over the text, folded to lower case.
Only where it stops is a pattern tried, anchored at the keyword. Runs of hex
digits have no keyword; a search for the shortest run over a text of character
classes takes its place. Kinds with a checksum inside are confirmed by it.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import arrow_schema, one_column, slices, utf8

BASE_KINDS = ("assign", "access", "hex")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

# Keywords with the pattern tried at each of them. Patterns are over UTF-8 bytes.
ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
PREFIXED = re.compile(rb"(?:gh[pousr]|npm)_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
EXTENDED = re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![0-9A-Za-z])")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_WORDS = ("akia",)
PREFIXED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
EXTENDED_WORDS = ("xprv",)
KINDS = (*BASE_KINDS, "hosting", "wallet")
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX_CLASS = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_HIGH = bytes(range(128, 192))  # bytes that continue a character

COLUMNS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def crc_ok(body: bytes) -> bool:
    """Thirty characters, then their CRC-32 in six base-62 digits."""
    rest, digits = zlib.crc32(body[:30]), ""
    for _ in range(6):
        rest, d = divmod(rest, 62)
        digits = BASE62[d] + digits
    return digits.encode() == body[30:]


def base58check_ok(text: bytes) -> bool:
    """Base 58 of 78 bytes and the first four of their double SHA-256."""
    value = 0
    for c in text.decode("ascii"):
        value = value * 58 + BASE58.index(c)
    if value >= 1 << (82 * 8):
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:78]).digest()).digest()[:4] == raw[78:]


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """Every keyword with its length and kind."""
    a = ahocorasick.Automaton()
    for kind, group in (
        ("assign", ASSIGN_WORDS),
        ("access", ACCESS_WORDS),
        ("hosting", PREFIXED_WORDS),
        ("wallet", EXTENDED_WORDS),
    ):
        for word in group:
            a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def scan(text: bytes) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in bytes, ordered by start, then by kind as listed.

    Base kinds are leftmost and do not overlap within a kind; a match that is
    too short still takes its place, as in a plain search with the pattern.
    """
    found: list[tuple[str, int, int]] = []
    free = dict.fromkeys(KINDS, 0)
    # latin-1 keeps one character per byte, so places are byte offsets.
    hits = sorted((end - n + 1, kind) for end, (n, kind) in automaton().iter(text.translate(_LOWER).decode("latin-1")))
    for start, kind in hits:
        if start < free[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(text, start)
            good = m and len(m[2]) >= MIN_VALUE
        elif kind == "access":
            m = ACCESS.match(text, start)
            good = m and len(m[0]) >= MIN_ACCESS
        elif kind == "hosting":
            m = PREFIXED.match(text, start)
            good = m and crc_ok(m[1])
        else:
            m = EXTENDED.match(text, start)
            good = m and base58check_ok(m[0])
        if m and (good or kind in BASE_KINDS):
            free[kind] = m.end()
            if good:
                found.append((kind, start, m.end()))
    classes, wanted, at = text.translate(_HEX_CLASS), b"h" * MIN_HEX, 0
    while (at := classes.find(wanted, at)) >= 0:
        m = HEX.match(text, at)
        found.append(("hex", at, m.end()))
        at = m.end()
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def in_characters(text: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans counted in code points; each stretch of the text is read once."""
    if not spans or text.isascii():
        return spans
    places, at, seen = {}, 0, 0
    for p in sorted({p for _, s, e in spans for p in (s, e)}):
        part = text[at:p]
        seen += len(part.translate(None, _HIGH))
        at = p
        places[p] = seen
    return [(k, places[s], places[e]) for k, s, e in spans]


def find_secrets(documents: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, digest of their spans, all spans as text.

    Spans are in code points, end exclusive. A null or empty text has none;
    repeated rows get equal results; an empty table gives an empty one; other columns are left out.
    Where spans of several kinds begin at one place, kinds come as listed. A very long text is read whole,
    in one row. Moves no rows.
    """
    docs = one_column(documents, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {COLUMNS}"
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                counts, digests, texts = {k: [] for k in BASE_KINDS}, [], []
                for text in utf8(part.column("text")):
                    spans = in_characters(text, scan(text))
                    shown = [(k, f"{k}:{s}:{e}") for k, s, e in spans]
                    for k in BASE_KINDS:
                        counts[k].append(sum(x[0] == k for x in shown))
                    base = ",".join(t for k, t in shown if k in BASE_KINDS)
                    digests.append(hashlib.sha256(base.encode()).hexdigest())
                    texts.append(",".join(t for _, t in shown))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(out.field(0).type),
                        *[pa.array(counts[k], pa.int64()) for k in BASE_KINDS],
                        pa.array(digests, pa.string()),
                        pa.array(texts, pa.string()),
                    ],
                    schema=out,
                )

    return docs.mapInArrow(run, schema)
