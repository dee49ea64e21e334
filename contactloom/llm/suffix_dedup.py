"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

Two equal strings of 400 bytes hold the same smallest 32-byte gram at the same
place, their anchor (winnowing). So only suffixes around anchors met more than
once have to be sorted, and those with the same anchor gram can be sorted
apart from all others. All windows around one anchor form a context; contexts
equal as a whole are settled by counting. The others are fed, in batches, to an
index family: a batch gets a suffix array, is merge-scanned against the arrays
of all levels for windows that are there already, and is merged with levels up
to its own size, so that levels grow geometrically.

Suffix arrays are ordered by the first eight bytes of the window that starts
at the suffix, then by a 64-bit fingerprint of the window: whether two suffixes
share 400 bytes is all that is asked of the order.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.session import written

from .batches import arrow_schema, one_column, slices, utf8
from .hot import join_counted

LENGTH, GRAM = 400, 32
# Bytes looked at at once; small enough for the processor's cache.
STEP = 1 << 18
# Windows in a batch of the family; bytes of contexts in a task; an anchor gram with more is dealt to several tasks,
# at the price of a row for each of its windows.
BATCH, TASK_BYTES = 1 << 18, 4 << 20
# Pairs of windows compared at once, byte by byte.
COMPARED = 1 << 11
# Different texts a task remembers, to hand on copies once.
REMEMBERED = 500_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from every place on; from two overlapping halves where size is no power of two."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    width = 1
    while width < size:
        shift = min(width, size - width)
        if len(h) <= shift:
            return h[:0]
        h = (h[:-shift] ^ (h[:-shift] >> np.uint64(29))) * _MIX[0] + (h[shift:] ^ (h[shift:] >> np.uint64(32))) * _MIX[1]
        width += shift
    return h


def contexts(texts: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(text, anchor gram, first window, last window) for all windows of all texts, cut where the anchor changes."""
    out = []
    pending: list[tuple[int, int, bytes]] = []
    held = 0

    def flush():
        nonlocal held
        if pending:
            out.extend(_contexts_of(pending))
            pending.clear()
            held = 0

    for i, text in enumerate(texts):
        for start in range(0, max(0, len(text) - LENGTH + 1), STEP):
            piece = text[start : start + STEP + LENGTH - 1]
            pending.append((i, start, piece))
            held += len(piece)
            if held > STEP:
                flush()
    flush()
    return out


def _contexts_of(pieces: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int, int]]:
    data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    h = gram_hashes(data, GRAM)
    # The upper bits of the hash decide, then the place: the leftmost of equals.
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    wide, width = LENGTH - GRAM + 1, 1
    while width < wide:
        shift = min(width, wide - width)
        least = np.minimum(least[:-shift], least[shift:])
        width += shift
    anchor = (least & _PLACE).astype(np.int64)
    lengths = np.array([len(p) for _, _, p in pieces])
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(pieces)), lengths)[: len(anchor)]
    window = np.arange(len(anchor))
    window = window[window + LENGTH <= ends[owner]]
    change = np.flatnonzero((np.diff(anchor[window]) != 0) | (np.diff(owner[window]) != 0))
    first = window[np.concatenate([[0], change + 1])]
    last = window[np.concatenate([change, [len(window) - 1]])]
    grams = h[anchor[first]].view(np.int64)
    begins = (ends - lengths)[owner[first]]
    starts = np.array([s for _, s, _ in pieces])[owner[first]]
    names = np.array([i for i, _, _ in pieces])[owner[first]]
    return list(zip(names.tolist(), grams.tolist(), (first - begins + starts).tolist(), (last - begins + starts).tolist()))


class Level:
    """One suffix array: a sorted key per window, and the windows' numbers. Each key stands once."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        self.keys, self.numbers = keys, numbers


class Family:
    """Suffix arrays of geometric sizes over all windows added so far; ``hit`` says which were met twice."""

    def __init__(self):
        self.levels: list[Level] = []
        self.hit = np.zeros(0, bool)
        # All bytes so far, in batches, and where in them each window begins.
        self.data: list[np.ndarray] = []
        self.starts = np.zeros(0, np.int64)

    def add(self, texts: list[bytes]) -> None:
        """One batch: its windows get the next numbers, text by text."""
        base = len(self.hit)
        data = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts])
        begins = np.cumsum(lengths) - lengths
        counts = lengths - LENGTH + 1
        starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        prints = gram_hashes(data, LENGTH)[starts]
        head = np.zeros(len(starts), np.uint64)
        for i in range(8):
            head = (head << np.uint64(8)) | data[starts + i]
        order = np.lexsort((prints, head))
        # Big-endian bytes compare as the pair of numbers does.
        keys = np.empty((len(order), 2), ">u8")
        keys[:, 0], keys[:, 1] = head[order], prints[order]
        keys = keys.view("S16").ravel()
        numbers = order + base
        self.hit = np.concatenate([self.hit, np.zeros(len(order), bool)])
        self.starts = np.concatenate([self.starts, starts + sum(map(len, self.data))])
        self.data.append(data)
        same = keys[1:] == keys[:-1]
        self._meet(numbers[1:][same], numbers[:-1][same])
        single = np.concatenate([[True], ~same])
        new = Level(keys[single], numbers[single])
        for level in self.levels:
            self._scan(level, new)
        while self.levels and len(self.levels[-1].keys) <= len(new.keys):
            new = self._merged(self.levels.pop(), new)
        self.levels.append(new)

    def _scan(self, level: Level, new: Level) -> None:
        at = np.minimum(np.searchsorted(level.keys, new.keys), len(level.keys) - 1)
        met = level.keys[at] == new.keys
        self._meet(new.numbers[met], level.numbers[at[met]])

    def _meet(self, a: np.ndarray, b: np.ndarray) -> None:
        """Windows of equal keys are hit where their bytes are equal. Other windows with one key would be an error of the hash."""
        if not len(a):
            return
        whole = self.data[0] if len(self.data) == 1 else np.concatenate(self.data)
        self.data = [whole]
        # Neighbouring pairs of windows share all but a byte: of each such run the first, every LENGTH-th and the last are compared.
        left, right = self.starts[a], self.starts[b]
        order = np.lexsort((left, left - right))
        left, right = left[order], right[order]
        begin = np.concatenate([[True], (np.diff(left) != 1) | (np.diff(right) != 1)])
        end = np.concatenate([begin[1:], [True]])
        at = np.arange(len(left))
        place = at - np.maximum.accumulate(np.where(begin, at, 0))
        judged = np.flatnonzero((place % LENGTH == 0) | end)
        windows = np.lib.stride_tricks.sliding_window_view(whole, LENGTH)
        for some in np.array_split(judged, max(1, len(judged) // COMPARED)):
            if not (windows[left[some]] == windows[right[some]]).all():
                raise ValueError("two different strings have one 128-bit key")
        self.hit[a] = True
        self.hit[b] = True

    def _merged(self, a: Level, b: Level) -> Level:
        at = np.searchsorted(a.keys, b.keys)
        fresh = (at == len(a.keys)) | (a.keys[np.minimum(at, len(a.keys) - 1)] != b.keys)
        return Level(np.insert(a.keys, at[fresh], b.keys[fresh]), np.insert(a.numbers, at[fresh], b.numbers[fresh]))


# ---- the steps on Spark


def _new_texts(batches):
    """Parts of (key, text): texts of LENGTH bytes or more, copies met in one task once."""
    seen = set()
    for batch in batches:
        for part in slices(batch, "text"):
            new = []
            for text in utf8(part.column("text")):
                key = hashlib.md5(text).digest()
                new.append(len(text) >= LENGTH and key not in seen)
                if len(seen) < REMEMBERED:
                    seen.add(key)
            yield part.filter(pa.array(new, pa.bool_())).select(["key", "text"])


def _distinct_in_task(docs: DataFrame) -> DataFrame:
    """(key, text): texts of LENGTH bytes or more, copies met in one task once."""
    return docs.select("key", "text").mapInArrow(_new_texts, "key binary, text string")


def _context_rows(docs: DataFrame) -> DataFrame:
    """(gram, context, key, first, last): ``context`` is a 128-bit fingerprint of all bytes of its windows.

    Copies are left out on the way: apart, that would be a second Python worker for every task, kept by the executor.
    """

    def run(batches):
        for part in _new_texts(batches):
            raw, keys = utf8(part.column("text")), part.column("key").to_pylist()
            rows = contexts(raw)
            if rows:
                owner, grams, first, last = zip(*rows)
                prints = [xxhash.xxh3_128_digest(raw[i][a : b + LENGTH]) for i, _, a, b in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams, pa.int64()),
                        pa.array(prints, pa.binary()),
                        pa.array([keys[i] for i in owner], pa.binary()),
                        pa.array(first, pa.int64()),
                        pa.array(last, pa.int64()),
                    ],
                    ["gram", "context", "key", "first", "last"],
                )

    return docs.select("key", "text").mapInArrow(run, "gram long, context binary, key binary, first long, last long")


def _with_bytes(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted contexts (gram, key, first, last, open)."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("gram", "first", "last", "open")).alias("wanted"))

    def run(batches):
        last_key = None
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for key, text, rows in zip(part.column("key").to_pylist(), utf8(part.column("text")), part.column("wanted").to_pylist()):
                    if key != last_key:  # copies from several tasks follow each other
                        out += [(r["gram"], key, r["first"], r["open"], text[r["first"] : r["last"] + LENGTH]) for r in rows]
                    last_key = key
                if out:
                    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["gram", "key", "first", "open", "bytes"]
                    )

    met = texts.join(lists, "key").sortWithinPartitions("key")
    return met.mapInArrow(run, "gram long, key binary, first long, open boolean, bytes binary")


def _indexed(rows: DataFrame, tasks: int) -> DataFrame:
    """What the index families find. Kind 0: repeated bytes (key, start, stop).

    Kind 1, for grams dealt to several tasks: windows not yet met twice or
    standing for others (head, print, key, start, and whether they still are open).
    """

    def run(batches):
        family = Family()
        owners: list[tuple] = []
        pending: list[bytes] = []
        held = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "first", "open", "split", "bytes")]
            for key, first, is_open, split, data in zip(*columns):
                owners.append((key, first, is_open, split, len(data) - LENGTH + 1))
                pending.append(data)
                held += len(data)
                if held > BATCH:
                    family.add(pending)
                    pending, held = [], 0
        if pending:
            family.add(pending)
        yield from _found(family, owners)

    laid = rows.repartition(tasks, "gram", "salt")
    return laid.mapInArrow(run, "kind int, key binary, start long, stop long, head_print binary, open boolean")


def _found(family: Family, owners: list[tuple]):
    names = ["kind", "key", "start", "stop", "head_print", "open"]
    kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
    if not owners:
        return
    sizes = np.array([n for *_, n in owners], np.int64)
    ends = np.cumsum(sizes)
    firsts = np.array([first for _, first, *_ in owners], np.int64)
    is_open = np.array([x for _, _, x, _, _ in owners], bool)
    split = np.array([x for _, _, _, x, _ in owners], bool)

    def batches(rows):
        while some := list(itertools.islice(rows, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), kinds)], names)

    def repeated():
        for (key, first, wanted, _, n), end in zip(owners, ends.tolist()):
            if not wanted:
                continue
            hit = family.hit[end - n : end]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            for a, b in edge.reshape(-1, 2).tolist():
                yield 0, key, first + a, first + b - 1 + LENGTH, None, None

    def shown():
        """One window of every key, of the rows whose gram other tasks have too."""
        for level in family.levels:
            owner = np.searchsorted(ends, level.numbers, "right")
            for at in np.array_split(np.flatnonzero(split[owner]), len(owner) // 50_000 + 1):
                own, number = owner[at], level.numbers[at]
                start = firsts[own] + number - (ends - sizes)[own]
                late = is_open[own] & ~family.hit[number]
                for o, x, k, y in zip(own.tolist(), start.tolist(), level.keys[at].tolist(), late.tolist()):
                    yield 1, owners[o][0], x, x + LENGTH, k.ljust(16, b"\0"), y

    yield from batches(repeated())
    if split.any():
        yield from batches(shown())


def _tasks(rows: DataFrame) -> int:
    size = rows.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, spans): start and stop of repeated bytes, from (key, text) with texts that may repeat a key."""
    rows = written(_context_rows(docs), "suffix-contexts")
    grams = rows.groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high")
    )
    often = written(grams.filter("n > 1").select("gram", "n", (F.col("low") < F.col("high")).alias("mixed")), "suffix-grams")
    met = written(join_counted(rows, often, ["gram"], "n").drop("n"), "suffix-met")
    # Texts from several tasks come several times with one key: that too is a repeated text.
    groups = met.groupBy("gram", "context").agg(
        F.count(F.lit(1)).alias("n"), F.max("mixed").alias("mixed"), F.min_by(F.struct("key", "first", "last"), "key").alias("one")
    )
    groups = written(groups, "suffix-groups")
    whole = join_counted(met, groups.filter("n > 1").select("gram", "context", "n"), ["gram", "context"], "n")
    spans = whole.select("key", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("stop"))
    wanted = groups.filter("mixed").select("gram", "one.*", (F.col("n") == 1).alias("open"))
    data = written(_with_bytes(_distinct_in_task(docs), wanted), "suffix-bytes")
    sizes = data.groupBy("gram").agg(F.sum(F.octet_length("bytes")).alias("size"))
    share = sizes.select("gram", F.ceil(F.col("size") / TASK_BYTES).cast("int").alias("salts"))
    share = written(share.filter("salts > 1"), "suffix-shares")
    split = join_counted(data, share, ["gram"], "salts", "left").withColumn("split", F.col("salts").isNotNull())
    salted = split.withColumn("salt", F.pmod(F.xxhash64("key", "first"), F.coalesce("salts", F.lit(1))))
    found = written(_indexed(salted.select("gram", "salt", "key", "first", "open", "split", "bytes"), _tasks(data)), "suffix-found")
    across = found.filter("kind = 1")
    twice = across.groupBy("head_print").count().filter("count > 1").select("head_print")
    late = across.filter("open").join(twice, "head_print", "left_semi")
    every = spans.unionByName(found.filter("kind = 0").select("key", "start", "stop")).unionByName(
        late.select("key", "start", "stop")
    )
    return every.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def merged_spans(start: np.ndarray, stop: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Sorted, and joined where they overlap or touch."""
    if not len(start):
        return []
    order = np.argsort(start)
    start, stop = start[order], np.maximum.accumulate(stop[order])
    begin = np.concatenate([[True], start[1:] > stop[:-1]])
    end = np.concatenate([begin[1:], [True]])
    return list(zip(start[begin].tolist(), np.minimum(stop[end], n).tolist()))


def remove_repeats(documents: DataFrame, with_kept: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``with_kept`` the remaining bytes too.

    Every byte is removed that a string of LENGTH bytes covers which starts
    anywhere else too, in this document or another. Strings are judged on the
    input. A null text is empty; texts under LENGTH bytes lose nothing; rows with equal texts of
    LENGTH bytes or more lose everything, whatever their ids. An empty table gives an empty one. Other columns are
    left out. A very long text is scanned in parts, and cut as one row.

    Equal texts are one text after the first scan. Moved are: anchors (one for
    about 185 bytes), texts that hold contexts to compare, and every text once
    to be cut.
    """
    docs = one_column(documents, "doc_id", "text").withColumn(
        "key", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    )
    spans = repeated_spans(docs)
    long = docs.filter(F.octet_length("text") >= LENGTH)
    copies = long.groupBy("key").count().filter("count > 1").select("key", F.lit(True).alias("copied"), F.col("count").alias("n"))
    # Copies go as a whole, so their spans needn't follow each of them.
    marks = copies.join(spans, "key", "full_outer").withColumns(
        {"n": F.coalesce("n", F.lit(1)), "spans": F.when(F.col("copied").isNull(), F.col("spans"))}
    )
    # The copies of one text stay where they are; every other text moves once.
    return _cut(join_counted(docs, written(marks, "suffix-marks"), ["key"], "n", "left"), with_kept)


def _cut(state: DataFrame, with_kept: bool) -> DataFrame:
    kind = state.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                spans = part.column("spans")
                flat = spans.flatten()
                start, stop = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop"))
                ends = np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
                before = 0
                for text, copied, end in zip(utf8(part.column("text")), part.column("copied").to_pylist(), ends.tolist()):
                    n = len(text)
                    gone = [(0, n)] if copied else merged_spans(start[before:end], stop[before:end], n)
                    before = end
                    kept, at = [], 0
                    for a, b in gone:
                        kept.append(text[at:a])
                        at = b
                    rest = b"".join([*kept, text[at:]])
                    rows.append((n, n - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(out)[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(out.field(0).type), *columns], schema=out)

    return state.select("doc_id", "text", "copied", "spans").mapInArrow(run, schema)
