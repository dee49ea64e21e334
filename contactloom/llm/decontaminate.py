"""Benchmark decontamination by Wu-Manber search over words.

A window is thirteen consecutive words of a benchmark item, or the whole item
where it is shorter. The windows are the patterns, words are the letters. For
patterns of one length, a shift table over blocks of words tells how far the
search may jump, the last block selects the bucket of patterns that may end
here, and a direct comparison confirms. Patterns of different lengths have
tables of their own, since one short pattern would shorten every jump.

Tables are arrays: some forty bytes for each word of an item. Texts are walked
side by side, a cursor for each stretch of a text, so that a jump is a step of
an array. Words stand as hashes; two blocks that meet in one cell of the shift table only
shorten jumps, and a window counts only where its words are the same byte by byte.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactloom.session import written

from .batches import one_column, slices, utf8
from .vocabulary import Words

WINDOW = 13
BLOCK = 3
# Item text searched for at once; more items take further passes over the documents.
PASS_BYTES = 32 << 20
# Words of a text that one cursor walks over; bits of a bucket's number.
STRETCH, BUCKET_BITS = 2048, 20
FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

# Lower-cases A-Z and turns every ASCII byte that belongs to no word into a space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    """ASCII letters in lower case, digits, and everything beyond ASCII."""
    return text.translate(_FOLD).split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[1]
    return x ^ (x >> np.uint64(29))


def _run_hash(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on."""
    x = hashes[at]
    for j in range(1, n):
        x = _mixed(x) * _ODD[0] + hashes[at + j]
    return _mixed(x * _ODD[2])


class Tables:
    """Wu-Manber tables for windows of one length, given by the places they begin at."""

    def __init__(self, length: int, hashes: np.ndarray, places: np.ndarray):
        self.length, self.block = length, min(BLOCK, length)
        bits = min(26, max(10, int(8 * len(places)).bit_length()))
        self.drop = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, length - self.block + 1, np.uint8)
        for end in range(self.block, length + 1):  # ever shorter jumps, so the shortest stays
            self.shift[self._cell(hashes, places + end - self.block)] = length - end
        keys = self._keys(hashes, places)
        order = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[order], places[order]

    def _cell(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _run_hash(hashes, at, self.block) >> self.drop

    def _keys(self, hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The bucket, from the last block, then the window in it."""
        bucket = _run_hash(hashes, places + self.length - self.block, self.block) >> np.uint64(64 - BUCKET_BITS)
        return (bucket << np.uint64(64 - BUCKET_BITS)) | (_run_hash(hashes, places, self.length) >> np.uint64(BUCKET_BITS))

    def candidates(self, hashes: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the texts, first and last of the windows in the table with its key) wherever a walk stops for a key that is there."""
        lanes = np.maximum(0, -(-(sizes - self.length + 1) // STRETCH))
        first = np.repeat(begins, lanes) + STRETCH * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        last = np.minimum(first + STRETCH, np.repeat(begins + sizes - self.length + 1, lanes))
        stops = []
        at = first
        while len(at):
            step = self.shift[self._cell(hashes, at + self.length - self.block)]
            stops.append(at[step == 0])
            at = at + np.maximum(step, 1)
            going = at < last
            if not going.all():
                at, last = at[going], last[going]
        at = np.concatenate(stops) if stops else np.zeros(0, np.int64)
        keys = self._keys(hashes, at)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        met = low < high
        return at[met], low[met], high[met]


class Searcher:
    """All tables of one set of items, given as (item id, text)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        vocabulary = Words()
        hashes, lengths, spelt = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], []
        for _, text in items:
            found = words(text)
            numbers = vocabulary.numbers(found)
            hashes.append(vocabulary.hashes[numbers])
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)) + 1)
            if found:
                spelt.append(b" ".join(found))
        self.names = [item for item, _ in items]
        sizes = np.array([len(h) for h in hashes[1:]], np.int64)
        self.begins = np.cumsum(sizes) - sizes
        flat = np.concatenate(hashes)
        # The words of all items in one string, for the comparison.
        self.text = b" ".join(spelt)
        self.offsets = np.cumsum(np.concatenate(lengths))
        self.tables = []
        for n in sorted(set(np.minimum(sizes, window).tolist()) - {0}):
            whole = sizes == n if n < window else sizes >= n
            counts = sizes[whole] - n + 1
            places = np.repeat(self.begins[whole] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            self.tables.append(Tables(n, flat, places))

    @property
    def n_bytes(self) -> int:
        return len(self.text) + self.offsets.nbytes + sum(t.shift.nbytes + t.keys.nbytes + t.places.nbytes for t in self.tables)

    def search(self, texts: list[list[bytes]], vocabulary: Words) -> list[tuple[bytearray, set[str]]]:
        """Of each text the mask of its hit words, and the items they come from."""
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        flat = [w for t in texts for w in t]
        numbers = vocabulary.numbers(flat)
        hashes = vocabulary.hashes[numbers]
        out = [(bytearray(len(t)), set()) for t in texts]
        for tables in self.tables:
            n = tables.length
            at, low, high = tables.candidates(hashes, begins, sizes)
            owner = np.searchsorted(begins, at, "right") - 1
            for place, i, a, b in zip(at.tolist(), owner.tolist(), low.tolist(), high.tolist()):
                here = b" ".join(flat[place : place + n])
                found = self._items(tables, a, b, here)
                if found:
                    mask, items = out[i]
                    inside = place - int(begins[i])
                    mask[inside : inside + n] = b"\x01" * n
                    items |= found
        return out

    def _items(self, tables: Tables, low: int, high: int, here: bytes) -> set[str]:
        """The items of the windows of one key that are the same words."""
        places = tables.places[low:high]
        first, last = self.offsets[places], self.offsets[places + tables.length] - 1
        same = [p for p, a, b in zip(places.tolist(), first.tolist(), last.tolist()) if self.text[a:b] == here]
        return {self.names[i] for i in np.unique(np.searchsorted(self.begins, same, "right") - 1).tolist()} if same else set()


#: The searcher of the items a process met last, under the mark of the search they belong to.
_LATEST: dict[str, Searcher] = {}


def _searcher(mark: str, items: list[tuple[str, bytes]]) -> Searcher:
    """Built once in a process, not in every task."""
    if mark not in _LATEST:
        _LATEST.clear()
        _LATEST[mark] = Searcher(items)
    return _LATEST[mark]


def item_groups(benchmark: DataFrame, most: int = PASS_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items in groups of about ``most`` bytes of text, one in memory at a time; at least one group, if an empty one.

    Rows without id or without a word take no part.
    """
    rows = one_column(benchmark, "item_id", "text").filter("item_id is not null and text is not null")
    group, held = [], 0
    for row in rows.select(F.col("item_id").cast("string").alias("item"), "text").toLocalIterator():
        text = row["text"].encode()
        if group and held + len(text) > most:
            yield group
            group, held = [], 0
        group.append((row["item"], text))
        held += len(text)
    yield group


def _unused(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name


def find_items(documents: DataFrame, benchmark: DataFrame, most: int = PASS_BYTES) -> DataFrame:
    """``documents`` with FOUND columns added: which words lie in benchmark windows.

    Every occurrence of every window counts. A null or wordless text has zero
    words, no items and is clean; repeated rows get equal results; an empty
    benchmark finds nothing; an empty table of documents gives an empty one. A very long text is
    searched whole, in one task. Other columns pass through, whatever their names. A column of the input
    that has one of the new names is replaced.

    The search moves no rows. A benchmark beyond ``most`` bytes is searched in
    groups, one pass over the documents each; documents are then written once, and a
    pass writes marks only, of the documents it finds something in.
    """
    added = [f.split()[0] for f in FOUND.split(", ")]
    kept = [c for c in documents.columns if c not in added]
    docs = one_column(documents, *kept)
    docs.select("text")
    row, mask, names = (_unused(n, kept) for n in ("_row", "_hit", "_items"))
    groups = item_groups(benchmark, most)
    first, second = next(groups), next(groups, None)
    if second is None:
        return _judged(_pass(docs, first, kept, mask, names), kept, mask, names)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-documents")
    marks = None
    for items in _with(first, second, groups):
        found = _pass(numbered.select(row, "text"), items, [row], mask, names).filter(F.size(names) > 0)
        found = written(found, "decontaminate-marks")
        marks = found if marks is None else marks.unionByName(found)
    # A document's marks are a row for each pass that hit it.
    lists = marks.groupBy(row).agg(F.collect_list(mask).alias(mask), F.array_distinct(F.flatten(F.collect_list(names))).alias(names))
    whole = numbered.join(lists, row, "left")
    return _judged(_united(whole, kept, mask, names), kept, mask, names)


def _with(*parts):
    first, second, rest = parts
    yield first
    yield second
    yield from rest


def _pass(docs: DataFrame, items: list[tuple[str, bytes]], kept: list[str], mask: str, names: str) -> DataFrame:
    """``kept`` columns with the mask of hit words, a byte each, and the items found."""
    given, mark = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches):
        searcher, vocabulary = _searcher(mark, given.value), Words()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found = searcher.search([words(t) for t in utf8(part.column("text"))], vocabulary)
                columns = [part.column(c) for c in kept]
                columns += [pa.array([bytes(m) for m, _ in found], pa.binary()), pa.array([sorted(n) for _, n in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, [*kept, mask, names])

    return docs.mapInArrow(run, _marked(docs, kept, mask, names))


def _marked(docs: DataFrame, kept: list[str], mask: str, names: str) -> T.StructType:
    marks = [T.StructField(mask, T.BinaryType()), T.StructField(names, T.ArrayType(T.StringType()))]
    return T.StructType([*[docs.schema[c] for c in kept], *marks])


def _united(docs: DataFrame, kept: list[str], mask: str, names: str) -> DataFrame:
    """The masks of all passes over each other; documents without any get an empty one of their length."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                masks = []
                for text, lists in zip(utf8(part.column("text")), part.column(mask).to_pylist()):
                    whole = np.zeros(len(words(text)), np.uint8)
                    for m in lists or ():
                        whole |= np.frombuffer(m, np.uint8)
                    masks.append(whole.tobytes())
                columns = [*[part.column(c) for c in kept], pa.array(masks, pa.binary()), part.column(names)]
                yield pa.RecordBatch.from_arrays(columns, [*kept, mask, names])

    return docs.select(*kept, mask, names).mapInArrow(run, _marked(docs, kept, mask, names))


def _judged(state: DataFrame, kept: list[str], mask: str, names: str) -> DataFrame:
    """Counts from the masks: one byte per word, 1 where it is hit."""
    hits = F.length(F.regexp_replace(F.hex(mask), "00", "")) / 2
    items = F.sort_array(F.coalesce(F.col(names), F.array().cast("array<string>")))
    found = {
        "n_words": F.octet_length(mask).cast("long"),
        "n_hit": hits.cast("long"),
        "n_items": F.size(items).cast("long"),
        "items_sha256": F.sha2(F.array_join(items, ","), 256),
    }
    counted = state.withColumns(found).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
    return counted.select(*kept, *[f.split()[0] for f in FOUND.split(", ")])


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, columns as given."""
    added = {f.split()[0] for f in FOUND.split(", ")}
    if added & set(documents.columns):
        raise ValueError(f"rename the columns {sorted(added & set(documents.columns))} first")
    return find_items(documents, benchmark).filter("not contaminated").select(*documents.columns)
