"""Quality rules: counts of a text, and how much more its n-grams look like trusted text than like the corpus.

Single words and pairs of words are hashed into a fixed number of buckets. Two
multinomials over the buckets are counted: one over every document, one over
every trusted document. A document's score is the mean over its n-grams of
log(trusted probability / corpus probability); under the threshold it is dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.operators.skew import hot_keys, salted_join
from contactloom.session import written

from .batches import arrow_schema, one_column, slices, utf8
from .vocabulary import Words

# Size of the two multinomials; the largest thing the driver holds.
BUCKETS = 1 << 16
# Parts a range of scores is divided into at once.
PARTS = 1024
# Added to every bucket count of the trusted multinomial, as a share of the corpus multinomial.
PRIOR = 200.0
# Share of trusted documents that may lie under the threshold, and the room left below it.
MISSED, ROOM = 0.001, 0.25
MIN_WORDS, REPEATED_PERCENT = 50, 50

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_HIGH = bytes(range(128, 192))
_PAIR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def repeated_words(numbers: np.ndarray) -> int:
    """Words in windows of three that occur twice or more."""
    if len(numbers) < 4:
        return 0
    local = np.unique(numbers, return_inverse=True)[1].astype(np.int64) if numbers.max() >= 1 << 21 else numbers
    if len(local) >= 1 << 21 and local.max() >= 1 << 21:
        # Numbers too large to pack three of them: pairs first, then pair and word.
        pairs = np.unique(local[:-1] * (local.max() + 1) + local[1:], return_inverse=True)[1].astype(np.int64)
        keys = pairs[:-1] * (local.max() + 1) + local[2:]
    else:
        keys = (local[:-2] << 42) | (local[1:-1] << 21) | local[2:]
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    # A window covers its own word and the next two.
    covered = np.zeros(len(numbers), bool)
    starts = np.zeros(len(keys), bool)
    starts[order[1:][same]] = True
    starts[order[:-1][same]] = True
    for shift in range(3):
        covered[shift : shift + len(keys)] |= starts
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def buckets(numbers: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Bucket of every word and of every pair of neighbours."""
    h = hashes[numbers]
    pairs = h[:-1] * _PAIR[0] + (h[1:] ^ (h[1:] >> np.uint64(31))) * _PAIR[1]
    return (np.concatenate([h, pairs]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def base_counts(text: bytes, split: list[bytes], numbers: np.ndarray) -> tuple:
    """The columns of BASE."""
    n = len(split)
    repeated = repeated_words(numbers)
    return (
        n,
        len(text.translate(None, _SPACES + _HIGH)),
        len(text) - len(text.translate(None, SYMBOLS)),
        duplicate_lines(text),
        repeated,
        n < MIN_WORDS or 100 * repeated > REPEATED_PERCENT * n,
    )


def trusted_labels(labels: DataFrame) -> DataFrame:
    """doc_id of every trusted document: of quality 1 and not toxic.

    Of contradicting labels of one document the worst counts. Rows without
    doc_id or quality take no part.
    """
    rows = one_column(labels, "doc_id", "quality", "toxic").filter("doc_id is not null and quality is not null")
    one = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return one.filter("quality = 1 and toxic = 0").select("doc_id")


def _marked(rows: DataFrame, trusted: DataFrame, spread: str, how: str = "left") -> DataFrame:
    """``rows`` with ``trusted``, whether their doc_id is; or the trusted ones alone (``left_semi``).

    Labels grow with the corpus, so they are never broadcast.
    """
    known = trusted.select(F.col("doc_id").try_cast(rows.schema["doc_id"].dataType).alias("doc_id"))
    if how == "left":
        known = known.withColumn("trusted", F.lit(True))
    return salted_join(rows, known.hint("merge"), "doc_id", how, F.col(spread), hot_keys(rows, "doc_id"))


def bucket_counts(documents: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts over all documents, and over the trusted ones."""
    marked = _marked(one_column(documents, "doc_id", "text"), trusted, "text").select(F.col("trusted").isNotNull().alias("trusted"), "text")
    schema = "bucket int, corpus long, trusted long"

    def run(batches):
        vocabulary = Words()
        corpus, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for chosen, text in zip(part.column("trusted").to_pylist(), utf8(part.column("text"))):
                    if split := text.split():
                        found = buckets(vocabulary.numbers(split), vocabulary.hashes)
                        np.add.at(corpus, found, 1)
                        if chosen:
                            np.add.at(good, found, 1)
        used = np.flatnonzero(corpus)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(corpus[used]), pa.array(good[used])],
            ["bucket", "corpus", "trusted"],
        )

    sums = marked.mapInArrow(run, schema).groupBy("bucket").agg(F.sum("corpus"), F.sum("trusted"))
    corpus, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, n, m in sums.collect():  # at most BUCKETS rows
        corpus[bucket], good[bucket] = n, m
    return corpus, good


def log_ratios(corpus: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """log(trusted probability / corpus probability) of each bucket; all zero without trusted text."""
    if not trusted.sum():
        return np.zeros(BUCKETS)
    raw = (corpus + 1) / (corpus.sum() + BUCKETS)
    prior = PRIOR * BUCKETS
    return np.log((trusted + prior * raw) / (trusted.sum() + prior)) - np.log(raw)


def _scored(documents: DataFrame, ratios: np.ndarray) -> DataFrame:
    docs = one_column(documents, "doc_id", "text")
    weights = docs.sparkSession.sparkContext.broadcast(ratios)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {BASE}, score double"
    out = arrow_schema(schema)

    def run(batches):
        vocabulary, weight = Words(), weights.value
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text in utf8(part.column("text")):
                    split = text.split()
                    numbers = vocabulary.numbers(split)
                    found = buckets(numbers, vocabulary.hashes) if split else ()
                    rows.append((*base_counts(text, split, numbers), float(weight[found].mean()) if split else 0.0))
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(out)[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(out.field(0).type), *columns], schema=out)

    return docs.mapInArrow(run, schema)


def values_at(counted: DataFrame, places: list[int]) -> dict[int, float]:
    """The values at these places (from 0) in the order of all values.

    ``counted`` holds (v, n): each different value once and how often it
    occurs. A range is divided into PARTS, whose counts say which part holds a
    place; that one is divided again until it holds one value.
    """
    found = {}
    low, high = counted.agg(F.min("v"), F.max("v")).first()
    ranges = [(low, high, 0, list(places))]
    while ranges:
        low, high, before, wanted = ranges.pop()
        if low == high:
            found |= dict.fromkeys(wanted, low)
            continue
        part = F.least(F.floor((F.col("v") - low) / (high - low) * PARTS), F.lit(PARTS - 1))
        sums = counted.filter(F.col("v").between(low, high)).groupBy(part.alias("part")).agg(F.min("v"), F.max("v"), F.sum("n"))
        for _, first, last, n in sorted(sums.collect()):  # at most PARTS rows
            if inside := [p for p in wanted if before <= p < before + n]:
                ranges.append((first, last, before, inside))
            before += n
    return found


def fitted_threshold(scored: DataFrame, trusted: DataFrame) -> float:
    """What nearly all trusted documents that pass the base rules lie above; minus infinity without any."""
    scores = _marked(scored.filter("not base_failed").select("doc_id", "score"), trusted, "score", "left_semi")
    counted = written(scores.groupBy(F.col("score").alias("v")).agg(F.count(F.lit(1)).alias("n")), "quality-scores")
    n = counted.agg(F.sum("n")).first()[0]
    if not n:
        return float("-inf")
    low = (n - 1) * MISSED
    around = [int(low), min(int(low) + 1, n - 1), (n - 1) // 2, n // 2]
    value = values_at(counted, sorted({*around}))
    below, above, first, second = [value[p] for p in around]
    low = float(np.quantile([below, above], low - int(low)))
    return low - ROOM * ((first + second) / 2 - low)


def judge_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document the BASE counts, ``kept``, then score and threshold.

    Null and empty texts have no words and fail the base rules. Without
    trusted labels nothing but the base rules decides. Repeated rows get equal
    results, though each adds to the corpus counts. Scores equal to the threshold are kept. An empty table of
    documents gives an empty one. A very long text is one row, judged whole. Other columns are left out.

    Two passes over the documents (counts; scores, which are written). Texts move once, to meet the trusted labels.
    """
    trusted = written(trusted_labels(labels), "quality-trusted")
    ratios = log_ratios(*bucket_counts(documents, trusted))
    scored = written(_scored(documents, ratios), "quality-scored")
    threshold = fitted_threshold(scored, trusted)
    return (
        scored.withColumn("threshold", F.lit(threshold))
        .withColumn("kept", F.expr("not base_failed and score >= threshold"))
        .select("doc_id", *[f.split()[0] for f in BASE.split(", ")], "kept", "score", "threshold")
    )
