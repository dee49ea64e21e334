"""Phrases whose words come together more often than they would by chance, counted in quotient filters.

A word is a 64-bit id, checked to be different for all words of the corpus; the
frequent ones are numbered, if they are not too many, so that two words fit
64 bits. A phrase is the packed numbers of its words. They are permuted
invertibly, so that the first 64 bits look random; their upper part is the
quotient, the rest and all further bits are the remainder. A filter keeps
remainders by quotient with a counter each and so gives back every phrase with
its exact count. Tasks fill filters, cut them by quotient into segments, and
segments of the same quotients are merged, sorted as they are, by adding counters.

Phrases are counted length by length. A phrase is counted only where both its
shorter parts may be frequent, as a bit array of bounded size tells; wrong
bits cost time and no result, since counts of what is counted are complete.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.operators.rank import top_n_per_group
from contactloom.session import written

from .batches import arrow_schema, one_column, slices, utf8
from .vocabulary import Words

LONGEST, LEAST, TOP = 5, 100, 2000
UNDETERMINED = "und"
# Bytes of the filters a task holds before it hands on segments; phrases gathered before they are added.
HELD_BYTES, GATHERED = 16 << 20, 1 << 17
# Different words a task remembers, and counts before it hands them on; rows in a batch of counts.
REMEMBERED, COUNTED, BATCH_ROWS = 300_000, 600_000, 1 << 16
# Frequent words are numbered up to so many (eight bytes each go to every task); beyond, ids stay as they are.
NUMBERED = 1 << 22
# Phrases merged in a task, about.
MERGED = 1 << 19
# Bits of a quotient; segments of a filter; counters up to this value take one byte.
QUOTIENT, SEGMENTS, SMALL = 16, 1 << 10, 255
# Bits of the array of frequent parts: so many for each, within these bounds.
BITS_EACH, FEWEST_BITS, MOST_BITS = 32, 1 << 20, 1 << 27
#: Characters that end a piece, as bytes.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_TO_BREAK = bytes.maketrans(BREAKS, b"\xff" * len(BREAKS))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


# ---- words


def mixed(x: np.ndarray) -> np.ndarray:
    """An invertible mixture of 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


_INVERSE = np.array([pow(int(m), -1, 1 << 64) for m in _ODD[:2]], np.uint64)


def unmixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _INVERSE[1]
    x = (x ^ (x >> np.uint64(29)) ^ (x >> np.uint64(58))) * _INVERSE[0]
    return x ^ (x >> np.uint64(32))


def pieces(text: bytes) -> list[bytes]:
    """The words of a text, with the byte 255, which no text holds, where a piece ends."""
    return text.lower().translate(_TO_BREAK).replace(b"\xff", b" \xff ").split()


class Alphabet:
    """How words are packed: two to a lane by their number among the frequent words, or, without numbers, one to a lane by id."""

    def __init__(self, ids: np.ndarray | None):
        self.ids = ids

    def lanes(self, k: int) -> int:
        return k if self.ids is None else -(-k // 2)

    def letters(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands for each word, and which words may be in a frequent phrase."""
        if self.ids is None:
            return ids, np.ones(len(ids), bool)
        at = np.minimum(np.searchsorted(self.ids, ids), max(0, len(self.ids) - 1))
        return at.astype(np.uint64), self.ids[at] == ids if len(self.ids) else np.zeros(len(ids), bool)

    def packed(self, letters: list[np.ndarray]) -> list[np.ndarray]:
        if self.ids is None:
            return letters
        pairs = [(a << np.uint64(32)) | b for a, b in zip(letters[::2], letters[1::2])]
        return [*pairs, letters[-1]] if len(letters) % 2 else pairs

    def unpacked(self, lanes: list[np.ndarray], k: int) -> list[np.ndarray]:
        """The ids of the words."""
        if self.ids is None:
            return lanes
        out = []
        for lane in lanes[: k // 2]:
            out += [lane >> np.uint64(32), lane & np.uint64(0xFFFFFFFF)]
        return [self.ids[x.astype(np.int64)] for x in (out if k % 2 == 0 else [*out, lanes[-1]])]


class Texts:
    """Word ids of texts, one after the other, and where words follow each other in a piece."""

    def __init__(self, seed: int):
        self.vocabulary, self.seed, self.languages = Words(), seed, {}

    def of(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(ids, whether it is a word) of all texts of a batch; each text ends with a break."""
        if len(self.vocabulary.number) > REMEMBERED:
            self.vocabulary = Words()
        languages = [UNDETERMINED if x is None else x for x in part.column("lang").to_pylist()]
        words: list[bytes] = []
        sizes = []
        for text in utf8(part.column("text")):
            found = pieces(text)
            found.append(b"\xff")
            words += found
            sizes.append(len(found))
        numbers = self.vocabulary.numbers(words)
        salts = np.repeat(np.array([self.salt(x) for x in languages], np.uint64), sizes)
        ids = mixed(self.vocabulary.hashes[numbers] ^ salts)
        return ids, numbers != self.vocabulary.number[b"\xff"]

    def salt(self, language: str) -> int:
        if language not in self.languages:
            # Seeds differ from that of words, since a word may be the name of a language.
            self.languages[language] = xxhash.xxh3_64_intdigest(language.encode(), self.seed + 1)
        return self.languages[language]


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, f, id) of all words; written."""
    out = arrow_schema("lang string, word string, f long")

    def run(batches):
        vocabulary = Words()
        # Per language a count for every number of the vocabulary.
        counts: dict[str, np.ndarray] = {}

        def rows():
            words = list(vocabulary.number)
            for language, found in counts.items():
                used = np.flatnonzero(found)
                for at in np.array_split(used, len(used) // BATCH_ROWS + 1):
                    columns = ([language] * len(at), [words[i].decode() for i in at.tolist()], found[at])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                if len(vocabulary.number) > COUNTED:
                    yield from rows()
                    counts.clear()
                    vocabulary = Words()
                languages = [UNDETERMINED if x is None else x for x in part.column("lang").to_pylist()]
                for language in set(languages):
                    own = [t for t, x in zip(utf8(part.column("text")), languages) if x == language]
                    numbers = vocabulary.numbers([w for t in own for w in pieces(t) if w != b"\xff"])
                    found = np.bincount(numbers, minlength=len(vocabulary.number))
                    before = counts.get(language, found[:0])
                    found[: len(before)] += before
                    counts[language] = found
        yield from rows()

    sums = docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    named = arrow_schema("lang string, word string, f long, id long")

    def name(batches):
        for batch in batches:
            texts = Texts(seed)
            numbers = texts.vocabulary.numbers(utf8(batch.column("word")))
            salts = np.array([texts.salt(x) for x in batch.column("lang").to_pylist()], np.uint64)
            ids = mixed(texts.vocabulary.hashes[numbers] ^ salts).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], schema=named)

    return written(sums.mapInArrow(name, "lang string, word string, f long, id long"), "collocation-words")


def numbered_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """``word_counts`` under the first seed that gives all words different ids, and that seed."""
    for seed in range(8):
        words = word_counts(docs, seed)
        if words.groupBy("id").count().filter("count > 1").isEmpty():
            return words, seed
    raise RuntimeError("no seed gives all words different ids")


# ---- filters


def permuted(lanes: list[np.ndarray]) -> list[np.ndarray]:
    """The first lane becomes a mixture of all."""
    first = lanes[0]
    for lane, odd in zip(lanes[1:], _ODD[1:]):
        first = first ^ mixed(lane * odd)
    return [mixed(first), *lanes[1:]]


def restored(lanes: list[np.ndarray]) -> list[np.ndarray]:
    first = unmixed(lanes[0])
    for lane, odd in zip(lanes[1:], _ODD[1:]):
        first = first ^ mixed(lane * odd)
    return [first, *lanes[1:]]


class QuotientFilter:
    """Counters of permuted keys in the order of quotient, then remainder."""

    def __init__(self, lanes: list[np.ndarray], counts: np.ndarray):
        self.lanes, self.counts = lanes, counts

    def __len__(self) -> int:
        return len(self.counts)

    @classmethod
    def of(cls, lanes: list[np.ndarray], counts: np.ndarray | None = None) -> QuotientFilter:
        """From keys in any order, which may repeat."""
        order = np.argsort(lanes[0], kind="stable")
        while True:
            sorted_lanes = [lane[order] for lane in lanes]
            near = sorted_lanes[0][1:] == sorted_lanes[0][:-1]
            same = near.copy()
            for lane in sorted_lanes[1:]:
                same &= lane[1:] == lane[:-1]
            if (same == near).all() or len(lanes) == 1:
                break
            # Different keys with one first lane: the others decide.
            resorted = np.lexsort([*lanes[:0:-1], lanes[0]])
            if (resorted == order).all():
                break
            order = resorted
        begin = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
        if counts is None:
            sums = np.diff(np.append(begin, len(order)))
        else:
            sums = np.add.reduceat(counts[order], begin) if len(begin) else np.zeros(0, np.int64)
        return cls([lane[begin] for lane in sorted_lanes], sums.astype(np.int64))

    def merged(self, *others: QuotientFilter) -> QuotientFilter:
        every = [self, *others]
        lanes = [np.concatenate([f.lanes[i] for f in every]) for i in range(len(self.lanes))]
        return QuotientFilter.of(lanes, np.concatenate([f.counts for f in every]))

    def segments(self) -> Iterator[tuple[int, int, bytes]]:
        """(segment, keys, packed filter): runs of remainders by quotient, counters of one byte where they fit."""
        shift = np.uint64(64 - SEGMENTS.bit_length() + 1)
        bounds = np.searchsorted(self.lanes[0] >> shift, np.arange(SEGMENTS + 1, dtype=np.uint64))
        width = (1 << QUOTIENT) // SEGMENTS
        for segment, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if a == b:
                continue
            quotients = (self.lanes[0][a:b] >> np.uint64(64 - QUOTIENT)).astype(np.int64) - segment * width
            counts = self.counts[a:b]
            large = counts >= SMALL
            packed = [
                np.array([b - a, int(large.sum())], "<u4").tobytes(),
                np.bincount(quotients, minlength=width).astype("<u4").tobytes(),
                self.lanes[0][a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 - QUOTIENT // 8].tobytes(),
                *[lane[a:b].astype("<u8").tobytes() for lane in self.lanes[1:]],
                np.minimum(counts, SMALL).astype(np.uint8).tobytes(),
                counts[large].astype("<u8").tobytes(),
            ]
            yield segment, b - a, b"".join(packed)

    @classmethod
    def unpacked(cls, segment: int, n_lanes: int, data: bytes) -> QuotientFilter:
        n, n_large = np.frombuffer(data, "<u4", 2).tolist()
        width, kept, at = (1 << QUOTIENT) // SEGMENTS, 8 - QUOTIENT // 8, 8
        runs = np.frombuffer(data, "<u4", width, at)
        at += 4 * width
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :kept] = np.frombuffer(data, np.uint8, n * kept, at).reshape(n, kept)
        at += n * kept
        quotients = np.repeat(np.arange(width, dtype=np.uint64) + np.uint64(segment * width), runs)
        lanes = [whole.view("<u8").ravel() | (quotients << np.uint64(64 - QUOTIENT))]
        for _ in range(n_lanes - 1):
            lanes.append(np.frombuffer(data, "<u8", n, at))
            at += 8 * n
        counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        counts[counts == SMALL] = np.frombuffer(data, "<u8", n_large, at + n)
        return cls(lanes, counts)


# ---- phrases


def place_of(lanes: list, bits: int) -> np.ndarray:
    """The bit that stands for a phrase."""
    x = lanes[0] * _ODD[0]
    for lane, odd in zip(lanes[1:], _ODD[1:]):
        x = (x ^ (x >> np.uint64(31))) * _ODD[4] + lane * odd
    return (mixed(x) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def bit_array(frequent: DataFrame, size: int) -> np.ndarray:
    """A bit for each frequent phrase (column ``place``), MOST_BITS at the most; built by aggregation, bounded for every corpus."""
    rows = frequent.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    out = np.zeros(size // 8, np.uint8)
    for r in rows.collect():
        part = np.frombuffer(r["bits"], np.uint8)
        begin = (r["bucket"] - 1) * len(part)
        out[begin : begin + len(part)] |= part[: len(out) - begin]
    return out


def _with_place(frequent: DataFrame, k: int, bits: int, given) -> DataFrame:
    """``place`` of every phrase in column ``ids``; bitmap buckets count places from 1."""
    out = arrow_schema("place long")

    def run(batches):
        alphabet = given.value
        for batch in batches:
            ids = np.array(batch.column("ids").to_pylist(), np.int64).reshape(-1, k).view(np.uint64)
            lanes = alphabet.packed([alphabet.letters(ids[:, j])[0] for j in range(k)])
            yield pa.RecordBatch.from_arrays([pa.array(place_of(lanes, bits) + 1, pa.int64())], schema=out)

    return frequent.select("ids").mapInArrow(run, "place long")


def filters(docs: DataFrame, seed: int, k: int, given, likely, bits: int) -> DataFrame:
    """(segment, slots, filter) of the phrases of ``k`` words whose parts of k - 1 words have their bits set."""
    out = arrow_schema("segment int, slots long, filter binary")

    def run(batches):
        alphabet, array, texts = given.value, likely.value, Texts(seed)
        slots = HELD_BYTES // (8 * alphabet.lanes(k) + 8)
        gathered: list[list[np.ndarray]] = []
        levels: list[QuotientFilter] = []
        held = 0

        def added():
            lanes = [np.concatenate([g[j] for g in gathered]) for j in range(alphabet.lanes(k))]
            new = QuotientFilter.of(permuted(lanes))
            # Filters of about equal size merge, so a phrase is moved a logarithmic number of times.
            while levels and len(levels[-1]) <= 2 * len(new):
                new = levels.pop().merged(new)
            levels.append(new)
            gathered.clear()

        def rows():
            whole = levels[0].merged(*levels[1:]) if len(levels) > 1 else levels[0]
            levels.clear()
            found = whole.segments()
            while some := list(itertools.islice(found, 64)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), out)], schema=out)

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids, is_word = texts.of(part)
                n = len(ids) - k + 1
                if n < 1:
                    continue
                letters, frequent = alphabet.letters(ids)
                ok = is_word & frequent
                ok = np.logical_and.reduce([ok[j : j + n] for j in range(k)])
                at = np.flatnonzero(ok)
                # The parts without the last and without the first word.
                for begin in (0, 1):
                    place = place_of(alphabet.packed([letters[at + begin + j] for j in range(k - 1)]), bits)
                    at = at[(array[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
                gathered.append(alphabet.packed([letters[at + j] for j in range(k)]))
                held += len(at)
                if held > GATHERED:
                    added()
                    held = 0
                    if sum(map(len, levels)) > slots:
                        yield from rows()
        if held:
            added()
        if levels:
            yield from rows()

    return docs.mapInArrow(run, "segment int, slots long, filter binary")


def merged_filters(parts: DataFrame, k: int, least: int, given) -> DataFrame:
    """(ids, f) of the phrases that occur ``least`` times, from the segments of all tasks."""
    out = arrow_schema("ids array<long>, f long")
    slots = parts.agg(F.sum("slots")).first()[0] or 0
    tasks = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(SEGMENTS, slots // MERGED))

    def rows(held, alphabet):
        whole = held[0].merged(*held[1:]) if len(held) > 1 else held[0]
        often = whole.counts >= least
        words = alphabet.unpacked(restored([lane[often] for lane in whole.lanes]), k)
        flat = np.stack(words, axis=1).view(np.int64).ravel()
        ids = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k), pa.int32()), pa.array(flat, pa.int64()))
        return pa.RecordBatch.from_arrays([ids.cast(out.field(0).type), pa.array(whole.counts[often], pa.int64())], schema=out)

    def run(batches):
        alphabet, last, held, grown = given.value, None, [], 0
        for batch in batches:
            for segment, data in zip(batch.column("segment").to_pylist(), batch.column("filter").to_pylist()):
                if segment != last and held:
                    yield rows(held, alphabet)
                    held, grown = [], 0
                last = segment
                held.append(QuotientFilter.unpacked(segment, alphabet.lanes(k), data))
                grown += len(held[-1])
                if len(held) > 1 and grown > 2 * len(held[0]):
                    held = [held[0].merged(*held[1:])]
                    grown = len(held[0])
        if held:
            yield rows(held, alphabet)

    laid = parts.repartition(tasks, "segment").sortWithinPartitions("segment")
    return laid.select("segment", "filter").mapInArrow(run, "ids array<long>, f long")


def frequent_phrases(docs: DataFrame, words: DataFrame, seed: int, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(ids, f) of all phrases of one to ``longest`` words that occur ``least`` times or more."""
    context = docs.sparkSession.sparkContext
    found = written(words.filter(F.col("f") >= least).select(F.array("id").alias("ids"), "f"), "collocation-1")
    every, n = found, found.count()
    ids = None
    if n <= NUMBERED:
        ids = np.sort(found.select(F.col("ids")[0].alias("id")).toArrow().column("id").to_numpy().view(np.uint64))
    given = context.broadcast(Alphabet(ids))
    for k in range(2, longest + 1):
        if not n:
            break
        bits = max(FEWEST_BITS, min(MOST_BITS, 1 << (n * BITS_EACH - 1).bit_length()))
        likely = context.broadcast(bit_array(_with_place(found, k - 1, bits, given), bits))
        parts = written(filters(docs, seed, k, given, likely, bits), f"collocation-filters-{k}")
        found = written(merged_filters(parts, k, least, given), f"collocation-{k}")
        every, n = every.unionByName(found), found.count()
    return every


def collocations(
    documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, drop_inner: bool = True
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score, cut.

    A text is lower-cased (A-Z) and cut into pieces at BREAKS and into words at
    spaces and tabs; a null lang is ``und``. n counts all words of the language,
    a the places of the phrase. Of the cuts into two parts, which occur l and r times, that
    with the lowest floor(1000 * a * n / (l * r)) counts, the earliest of equals
    (``cut`` words before it). With ``drop_inner`` a phrase goes that lies in a longer frequent one
    as often as it occurs at all. Ranks go by score, a, then phrase in byte order.

    Null and empty texts have no words; without words there are no rows, so an
    empty table gives none. Rows count as often as they repeat. Other columns are
    left out. A very long text is read as a whole by one task; what a task holds besides is bounded.

    Counters, not occurrences, are shuffled: a phrase that fills a third of the
    corpus is one counter a task. Scores are exact decimals.
    """
    docs = one_column(documents, "text", "lang").filter("text is not null")
    words, seed = numbered_words(docs)
    every = frequent_phrases(docs, words, seed, least, longest)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = words.filter(F.col("f") >= least).select("lang", "word", "id")
    # From ids to words; the words of a phrase share their language.
    placed = every.withColumn("key", F.col("ids")).select("key", "f", F.posexplode("ids").alias("at", "id"))
    spelt = (
        placed.join(often, "id")
        .groupBy("key")
        .agg(F.first("f").alias("f"), F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
        .select("lang", F.col("w.word").alias("words"), "f")
    )
    phrases = written(spelt, "collocation-phrases")
    size = F.size("words")
    candidates = phrases.filter(size > 1)
    cuts = candidates.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    halves = cuts.select(
        "*", F.slice("words", 1, F.col("cut")).alias("head"), F.expr("slice(words, cut + 1, size(words) - cut)").alias("tail")
    )
    scored = halves.join(phrases.select("lang", F.col("words").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(
        phrases.select("lang", F.col("words").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]
    )
    # Languages are few; their totals are one row each.
    scored = scored.join(totals, "lang").withColumn("score", F.expr(
        "(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div "
        "(cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    ))
    lowest = F.min(F.struct("score", "cut", "l", "r")).alias("best")
    best = scored.groupBy("lang", "words", "a", "n").agg(lowest).select("lang", "words", "a", "n", "best.*")
    if drop_inner:
        best = best.join(_inner(candidates), ["lang", "words", "a"], "left_anti")
    rows = best.select("lang", F.array_join("words", " ").alias("phrase"), "a", "l", "r", "n", "score", F.col("cut").cast("long"))
    return top_n_per_group(rows, ["lang"], [F.desc("score"), F.desc("a"), "phrase"], top, "rank")


def _inner(candidates: DataFrame) -> DataFrame:
    """(lang, words, a): stretches of longer phrases, with their counts."""
    return (
        candidates.filter(F.size("words") > 2)
        .select("lang", F.col("f").alias("a"), "words", F.explode(F.expr("sequence(2, size(words) - 1)")).alias("m"))
        .select("lang", "a", "words", "m", F.explode(F.expr("sequence(1, size(words) - m + 1)")).alias("i"))
        .select("lang", F.slice("words", F.col("i"), F.col("m")).alias("words"), "a")
        .distinct()
    )


#: By definition, with 128-bit integers.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, w[i : i + k - 1] AS g, k FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
    FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, g, k, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, g, k, f, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.g, c.f AS a, h.f AS l, t.f AS r, n.n, cut, (1000 * c.f * n.n) // (h.f * t.f) AS score
    FROM c JOIN f h ON h.lang = c.lang AND h.g = c.g[1 : cut] JOIN f t ON t.lang = c.lang AND t.g = c.g[cut + 1 :] JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
i AS (SELECT DISTINCT lang, g[j : j + m - 1] AS g, f FROM (SELECT lang, g, f, m, unnest(range(1, k - m + 2)) AS j
    FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2))),
kept AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = b.lang AND i.g = b.g AND 100 * i.f >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score, cut
FROM (SELECT *, array_to_string(g, ' ') AS phrase FROM kept) QUALIFY rank <= 2000
"""
