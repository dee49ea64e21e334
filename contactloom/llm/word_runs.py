"""Runs of repeated words, found while a suffix automaton grows.

A run is a longest stretch of words with smallest period q, that is words q
apart are equal, long enough to hold the period several times. Every appended
word adds a state to the suffix automaton of the text so far. The suffixes of
the text are the states on the path from that state to the root of the link
tree, and every state carries the place where its strings ended last. States
with the same last place lie on one path; each such segment is a splay tree of
a link-cut forest, so an append meets the segments above it one by one, and
recolours them all with the new place. A segment with last place e whose
strings are up to L words long says that L words end both at e and at the new
place i: for i - e <= L that is a square of period i - e, and no smaller one,
since the last place would be nearer. Its period is then followed to both sides.

Words that cannot lie in a run long enough are passed over first: every three
neighbouring words of a run of four periods or more occur three times in it.
Stretches of such words (islands) are counted again by themselves until nothing
is left out any more; each island gets an automaton of its own. Hashes serve
that choice only, so a collision costs time and no result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import arrow_schema, one_column, slices, utf8
from .vocabulary import Words

# Words in a run, and periods in it, at least. Islands need both as they are: six words, four periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
COLUMNS = (
    "n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class Automaton:
    """Suffix automaton of a growing text whose link tree is kept as link-cut segments of one last place."""

    def __init__(self):
        # State 0 is no state, 1 the root. ``left``, ``right`` and ``up`` are the splay trees, ordered by length;
        # ``up`` of a tree's root is the state the segment hangs from. ``place`` holds at the roots of trees.
        self.length, self.link, self.follow = [0, 0], [0, 0], [{}, {}]
        self.left, self.right, self.up, self.place = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.last, self.size = 1, 0

    def _state(self, length: int, link: int, follow: dict) -> int:
        for column, value in (
            (self.length, length),
            (self.link, link),
            (self.follow, follow),
            (self.left, 0),
            (self.right, 0),
            (self.up, link),
            (self.place, -1),
        ):
            column.append(value)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        """Makes x the root of its segment's tree."""
        left, right, up = self.left, self.right, self.up
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            if inner:
                self._turn(y if (left[z] == y) == (left[y] == x) else x)
            self._turn(x)

    def _turn(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        y = up[x]
        z = up[y]
        if left[y] == x:
            child = left[y] = right[x]
            right[x] = y
        else:
            child = right[y] = left[x]
            left[x] = y
        if child:
            up[child] = y
        if z and left[z] == y:
            left[z] = x
        elif z and right[z] == y:
            right[z] = x
        else:
            self.place[x] = self.place[y]
        up[x], up[y] = z, x

    def append(self, word: int) -> list[tuple[int, int]]:
        """Adds a word; (last place, length) of every segment on the path of the new suffixes, longest first."""
        at, follow, link, length = self.size, self.follow, self.link, self.length
        self.size += 1
        p, target = self.last, 0
        new = self._state(length[p] + 1, 1, {})
        while p:
            target = follow[p].get(word, 0)
            if target:
                break
            follow[p][word] = new
            p = link[p]
        if target:
            if length[target] != length[p] + 1:
                target = self._cloned(target, p, word)
            link[new] = self.up[new] = target
        self.last = new
        return self._recoloured(new, at)

    def _cloned(self, old: int, p: int, word: int) -> int:
        """The shorter strings of ``old`` get a state above it, with the same last place."""
        follow, link = self.follow, self.link
        clone = self._state(self.length[p] + 1, link[old], dict(follow[old]))
        self._splay(old)
        above = self.left[old]
        self.left[clone], self.left[old], self.up[clone] = above, clone, old
        if above:
            self.up[above] = clone
        link[old] = clone
        while p and follow[p].get(word) == old:
            follow[p][word] = clone
            p = link[p]
        return clone

    def _recoloured(self, new: int, at: int) -> list[tuple[int, int]]:
        left, right, up, place, length = self.left, self.right, self.up, self.place, self.length
        met, below, x = [], 0, new
        while x:
            self._splay(x)
            if place[x] >= 0:
                met.append((place[x], length[x]))
            deeper = right[x]
            if deeper:
                place[deeper] = place[x]
            right[x], below = below, x
            if not up[x]:
                break
            x = up[x]
        self._splay(new)
        place[new] = at
        return met


def _same_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """Number of places from the start on at which both agree."""
    at, step, most = 0, 32, min(len(a), len(b))
    while at < most:
        differs = np.flatnonzero(a[at : min(most, at + step)] != b[at : min(most, at + step)])
        if len(differs):
            return at + int(differs[0])
        at += step
        step *= 4
    return most


def runs(words: np.ndarray, least: float = LEAST_PERIODS, shortest: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words`` of two periods or more that is long enough, by start, then period."""
    automaton = Automaton()
    known: dict[int, int] = {}
    out = []
    for i, word in enumerate(words.tolist()):
        for place, length in automaton.append(word):
            q = i - place
            if q > length or known.get(q, -1) >= i:
                continue
            first = i - 2 * q + 1
            before = _same_ahead(words[:first][::-1], words[: first + q][::-1])
            after = _same_ahead(words[i + 1 :], words[i + 1 - q :])
            known[q] = i + after
            size = before + 2 * q + after
            if size >= max(shortest, least * q):
                out.append((first - before, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def islands(words: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of ``words`` that may hold a run; ``text`` numbers the text of each word, ascending."""
    if len(words) < LEAST_WORDS:
        return []
    x = words.astype(np.uint64)
    triple = (x[:-2] * _MIX[0] ^ (x[:-2] >> np.uint64(7))) + x[1:-1] * _MIX[1] + x[2:] * _MIX[2]
    triple ^= triple >> np.uint64(31)
    place = np.flatnonzero(text[:-2] == text[2:])
    owner = text[place]
    while True:
        key = triple[place] + owner.astype(np.uint64) * _MIX[3]
        order = np.sort(key)
        often = np.unique(order[2:][order[2:] == order[:-2]])
        if not len(often):
            return []
        at = np.minimum(np.searchsorted(often, key), len(often) - 1)
        kept = often[at] == key
        place, owner = place[kept], owner[kept]
        fresh = np.concatenate([[True], (np.diff(place) != 1) | (np.diff(owner) != 0)])
        number = np.cumsum(fresh) - 1
        sizes = np.bincount(number)
        large = sizes[number] >= LEAST_WORDS - 2
        place, owner = place[large], number[large]
        if not len(place):
            return []
        if kept.all() and large.all():
            break
    begin = np.concatenate([[True], np.diff(owner) != 0])
    end = np.concatenate([begin[1:], [True]])
    return list(zip(place[begin].tolist(), (place[end] + 3).tolist()))


def looped(words: list, doc_id) -> list:
    """The words of the text to judge: for a tenth of the ids the tail is a loop over its first words."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turns = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * turns)[: n - a]


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    gone = np.zeros(len(words), bool)
    for start, length, period in found:
        gone[start + period : start + length] = True
    return [w for w, g in zip(words, gone.tolist()) if not g]


def runs_of(texts: list[list], vocabulary: Words) -> Iterator[list[tuple[int, int, int]]]:
    """The runs of each text, given as words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    numbers = vocabulary.numbers([w for t in texts for w in t])
    found: list[list] = [[] for _ in texts]
    owner = np.repeat(np.arange(len(texts)), sizes)
    for begin, end in islands(numbers, owner):
        i = int(owner[begin])
        found[i] += [(begin - int(begins[i]) + start, n, q) for start, n, q in runs(numbers[begin:end])]
    for rows in found:
        yield sorted(rows, key=lambda r: (r[0], r[2]))


def _row(words: list, found: list[tuple[int, int, int]]) -> tuple:
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    rest = b" ".join(collapsed(words, found) if found else words)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(words), len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(rest).hexdigest(), found, rest)


def find_runs(documents: DataFrame, loop: bool = False, spans: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_runs, the longest run, digests of all runs and of the text without repeats.

    Words are what ASCII white space parts. A run has LEAST_WORDS words and
    LEAST_PERIODS of its smallest period or more. The longest run (ties:
    smallest start, then period) gives start, length, period and
    exponent_milli, all null without a run. A word goes from the collapsed text
    where a run contains it after its first period. ``spans`` adds ``runs`` (array of start,
    length, period) and ``collapsed`` (the words left, joined by a space).

    ``loop`` turns the tail of a tenth of the texts, chosen by the checksum of
    doc_id, into a loop before runs are sought (see ``looped``); rows without a doc_id keep theirs.

    A null, empty or blank text has no words and no run. Rows may repeat, each
    is judged by itself; an empty table gives an empty one; other columns are
    left out. A very long text is one row in one task: its automaton holds
    some hundred bytes a word, of the islands only, one at a time. Moves no rows.
    """
    docs = one_column(documents, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {COLUMNS}"
    if spans:
        schema += ", runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    out = arrow_schema(schema)

    def run(batches):
        vocabulary = Words()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids = part.column("doc_id").to_pylist()
                texts = [t.split() for t in utf8(part.column("text"))]
                if loop:
                    texts = [looped(t, i) for t, i in zip(texts, ids)]
                rows = [_row(t, f) for t, f in zip(texts, runs_of(texts, vocabulary))]
                columns = list(zip(*rows))
                if spans:
                    columns[8] = [[{"start": s, "length": n, "period": q} for s, n, q in f] for f in columns[8]]
                    columns[9] = [t.decode("utf-8", "replace") for t in columns[9]]
                fields = [out.field(i + 1) for i in range(len(out) - 1)]
                arrays = [pa.array(c, f.type) for c, f in zip(columns, fields)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(out.field(0).type), *arrays], schema=out)

    return docs.mapInArrow(run, schema)
