"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector over hashed runs of two and three letters.
Every language has several centroids, found by clustering its training vectors
by cosine. The language of the nearest centroid is predicted; a text too far
from it is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.session import written

from .batches import arrow_schema, one_column, slices
from .samples import sampled

FEATURES = 1 << 13
# Training texts of each language; clusters of each language; rounds of clustering.
TRAINING, CLUSTERS, ROUNDS = 600, 4, 12
# A text is rejected under this share of the similarity that nearly all training texts of a centroid reach.
MISSED, SHARE = 0.01, 0.6
# Letters needed before distance may reject: very short texts lie far from everything.
MIN_LETTERS = 40
UNDETERMINED = "und"
# Characters of a text, and texts, looked at together.
PART, TOGETHER = 1 << 20, 64
COLUMNS = "lang_pred string, score double, rejected boolean"


def letter_table() -> np.ndarray:
    """True for the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(text: str, letters: np.ndarray) -> tuple[np.ndarray, int]:
    """Counts of hashed letter runs (everything else reads as one space), and the number of letters.

    Long texts are counted in parts that overlap by the two characters a run needs.
    """
    whole = f" {text.lower()} "
    counts, n = _counted(whole[: PART + 2], letters)
    for at in range(PART, len(whole) - 2, PART):
        more, _ = _counted(whole[at : at + PART + 2], letters, at)
        counts += more
    return counts, n if len(whole) <= PART + 2 else sum(_letters(whole[i : i + PART], letters) for i in range(0, len(whole), PART))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _letters(text: str, letters: np.ndarray) -> int:
    return int(letters[_codes(text)].sum())


def _counted(text: str, letters: np.ndarray, at: int = 0) -> tuple[np.ndarray, int]:
    codes = _codes(text)
    is_letter = letters[codes]
    n = int(is_letter.sum())
    c = np.where(is_letter, codes, np.uint32(32))
    pairs = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    triples = (pairs[:-1] ^ (pairs[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    # Runs with a letter in them only; the first pair of a later part was the last of the one before.
    with_letter = is_letter[:-1] | is_letter[1:]
    if at:
        with_letter[0] = False
    two = pairs[with_letter]
    three = triples[is_letter[1:-1]]
    mixed = np.concatenate([two ^ (two >> np.uint32(16)), three ^ (three >> np.uint32(16))]) * np.uint32(0x2C1B3C6D)
    return np.bincount((mixed >> shift).astype(np.int64), minlength=FEATURES), n


@dataclass
class Centroids:
    """What prediction needs: a weight per feature, unit centroids, their languages and least similarities."""

    idf: np.ndarray
    vectors: np.ndarray
    langs: list[str]
    least: np.ndarray

    def predict(self, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid and cosine of each vector of counts."""
        x = weighted(np.stack(counts, dtype=np.float32, casting="unsafe"), self.idf)
        similar = x @ self.vectors.T
        best = similar.argmax(axis=1)
        return best, similar[np.arange(len(best)), best]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in place."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    x /= np.where(norm > 0, norm, 1)
    return x


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length 1, in the place of the counts."""
    np.log1p(counts, out=counts)
    counts *= idf
    return unit(counts)


def clustered(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart rows; the same result for the same rows in the same order."""
    chosen = [x.mean(axis=0)]
    near = x @ chosen[0]
    starts = []
    for _ in range(min(k, len(x))):
        starts.append(int(near.argmin()))
        near = np.maximum(near, x @ x[starts[-1]])
    centres = x[starts]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        member = (own[None, :] == np.arange(len(centres))[:, None]).astype(x.dtype)
        sums, sizes = member @ x, member.sum(axis=1)[:, None]
        centres = unit(np.where(sizes > 0, sums / np.maximum(sizes, 1), centres))
    return centres, (x @ centres.T).argmax(axis=1)


def weights(counts: np.ndarray, n: int) -> np.ndarray:
    """IDF from the number of texts with each feature, of ``n`` texts."""
    return (np.log((1 + n) / (1 + counts)) + 1).astype(np.float32)


def language_centroids(vectors: list[tuple[bytes, bytes]], idf: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Centroids of one language with their least similarities, from sparse vectors in any order."""
    x = np.zeros((len(vectors), FEATURES), np.float32)
    for row, (index, counts) in zip(x, sorted(vectors)):
        row[np.frombuffer(index, "<u2")] = np.frombuffer(counts, "<f4")
    x = weighted(x, idf)
    centres, member = clustered(x, CLUSTERS)
    everywhere = (x @ centres.T).max(axis=1)
    out = []
    for j, centre in enumerate(centres):
        near = everywhere[member == j]
        out.append((centre, float(SHARE * np.quantile(near if len(near) >= 20 else everywhere, MISSED))))
    return out


def sparse(text: str, letters: np.ndarray) -> tuple[bytes, bytes] | None:
    """The features of a text that occur, and how often; None where it has no letter."""
    counts, n = features(text, letters)
    if not n:
        return None
    used = np.flatnonzero(counts)
    return used.astype("<u2").tobytes(), counts[used].astype("<f4").tobytes()


def _model(idf: np.ndarray, found: list[tuple[str, np.ndarray, float]]) -> Centroids | None:
    if not found:
        return None
    langs, vectors, least = zip(*found)
    return Centroids(idf, np.stack(vectors), list(langs), np.array(least))


def fit(texts: list[tuple[str, str]]) -> Centroids | None:
    """Centroids from few (language, text) pairs at hand; None where no text has a letter."""
    table = letter_table()
    own: dict[str, list] = {}
    for lang, text in texts:
        if (vector := sparse(text, table)) is not None:
            own.setdefault(lang, []).append(vector)
    every = [np.frombuffer(index, "<u2") for vectors in own.values() for index, _ in vectors]
    if not every:
        return None
    idf = weights(np.bincount(np.concatenate(every), minlength=FEATURES), len(every))
    return _model(idf, [(lang, *c) for lang in sorted(own) for c in language_centroids(own[lang], idf)])


def fit_documents(documents: DataFrame, most: int = TRAINING) -> Centroids | None:
    """Centroids from ``most`` texts of each language, none of them held out; None without such texts.

    Texts are turned into sparse vectors where they are, and a language is
    clustered in a task of its own, which holds ``most`` dense vectors. The
    driver gets a number per feature and the centroids, 130 KB a language.
    """
    docs = one_column(documents, "doc_id", "text", "lang").filter("text is not null and lang is not null")
    chosen = sampled(docs.filter(~held_out()), ["doc_id", "text"], "lang", most)

    def turn(batches):
        table = letter_table()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                rows = [(lang, sparse(t, table)) for lang, t in zip(part.column("lang").to_pylist(), part.column("text").to_pylist())]
                rows = [(lang, *v) for lang, v in rows if v is not None]
                columns = list(zip(*rows)) or [(), (), ()]
                kinds = (pa.string(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["lang", "index", "counts"])

    vectors = written(chosen.select("lang", "text").mapInArrow(turn, "lang string, index binary, counts binary"), "language-vectors")

    def met(batches):
        counts = np.zeros(FEATURES, np.int64)
        for batch in batches:
            for index in batch.column("index").to_pylist():
                counts[np.frombuffer(index, "<u2")] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES)), pa.array(counts)], ["feature", "n"])

    sums = vectors.select("index").mapInArrow(met, "feature long, n long").filter("n > 0").groupBy("feature").agg(F.sum("n"))
    counts = np.zeros(FEATURES, np.int64)
    for feature, n in sums.collect():  # at most FEATURES rows
        counts[feature] = n
    idf = weights(counts, vectors.count())

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        found = language_centroids(list(zip(group["index"], group["counts"])), idf)
        rows = [(group["lang"].iloc[0], j, c.astype("<f4").tobytes(), least) for j, (c, least) in enumerate(found)]
        return pd.DataFrame(rows, columns=["lang", "place", "centre", "least"])

    rows = vectors.groupBy("lang").applyInPandas(cluster, "lang string, place int, centre binary, least double").collect()
    rows.sort(key=lambda r: (r["lang"], r["place"]))
    return _model(idf, [(r["lang"], np.frombuffer(r["centre"], "<f4"), r["least"]) for r in rows])


def held_out() -> F.Column:
    """Documents that are never learned from: CRC-32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(documents: DataFrame, model: Centroids | None) -> DataFrame:
    """``documents`` with COLUMNS added: language, cosine with its centroid from 0 to 1, and rejection.

    A null text and one without letters are ``und`` with score 0 and rejected,
    and so is everything without a model. Of equally near centroids the first
    counts, in the order of language names. Only the text decides, so equal texts get equal results. An empty table
    gives an empty one. Very long texts are read whole, one at a time. Other columns
    pass through, those with the new names are replaced. Moves no rows.
    """
    added = [f.split()[0] for f in COLUMNS.split(", ")]
    kept = [f for f in documents.schema.fields if f.name not in added]
    docs = one_column(documents, *[f.name for f in kept])
    docs.select("text")
    given = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept) + f", {COLUMNS}"
    out = arrow_schema(schema)

    def run(batches):
        table, centroids = letter_table(), given.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                langs, scores, rejected = [], [], []
                texts = part.column("text").to_pylist()
                for at in range(0, len(texts), TOGETHER):
                    found = [features(t or "", table) for t in texts[at : at + TOGETHER]]
                    sizes = [n for _, n in found]
                    if centroids is None:
                        best, near = [0] * len(found), [0.0] * len(found)
                    else:
                        best, near = centroids.predict([c for c, _ in found])
                    for n, b, s in zip(sizes, best, near):
                        known = n > 0 and centroids is not None
                        langs.append(centroids.langs[b] if known else UNDETERMINED)
                        scores.append(min(1.0, max(0.0, round(float(s), 6))) if known else 0.0)
                        rejected.append(not known or n >= MIN_LETTERS and float(s) < centroids.least[b])
                columns = [c.cast(f.type) for c, f in zip(part.columns, out)]
                columns += [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return docs.mapInArrow(run, schema)


def accuracy(predicted: DataFrame) -> float:
    """Share of held-out documents with a known language that were predicted right."""
    rows = predicted.filter(held_out() & F.col("lang").isNotNull())
    return rows.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
