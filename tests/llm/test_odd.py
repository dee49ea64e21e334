"""Every operator on null, empty, very long, tied and repeated rows, empty tables and columns of any name; fitted models by hand."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactloom.llm import (
    collocations, decontaminate, jaccard_join, language_id, line_spread, pieces, quality_rules, secrets, sharding, suffix_dedup,
    token_files, word_runs,
)
from contactloom.llm.registered import QUERIES
from contactloom.llm.vocabulary import Words

from . import brute

LONG = "the quick brown fox jumps over the lazy dog again " * 6_000
SAME = "one two three four five six seven eight nine ten " * 12
ROWS = [(1, None), (2, ""), (3, " \n"), (4, LONG), (5, SAME), (5, SAME), (6, SAME), (7, "a"), (None, None), (None, SAME), (8, "A"), (9, LONG[: -1])]
# Names the operators use themselves, or might.
CLASHING = (
    "n_words n_hit n_items _hit _items _row _gone _once _doc _size _hash _fine _f _leaf _family _place _n _sample key copied spans n "
    "line keeper rows region size sig core label depth bucket score rejected lang_pred segment filter slots ids id f word width _tie "
    "start length period kept base_failed n_lines n_removed component_id payload_digest _first _last times shingle"
).split()


def frame(spark, rows):
    plain = spark.createDataFrame([(i, t, None if (i or 0) % 2 else "en", f"s{(i or 0) % 3}") for i, t in rows], "doc_id long, text string, lang string, source string")
    return plain.select("*", *[F.lit(f"given {c}").alias(c) for c in CLASHING])


def path(name):
    return pytest.importorskip("public_tokenizers").path(name)


def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").select("*", *[F.lit(1).alias(c) for c in ("trusted", "_n")])


def items(spark):
    return spark.createDataFrame([(1, "two three four five six seven eight nine ten one two three four")], "item_id long, text string")


MODEL = language_id.fit([("en", SAME), ("en", LONG[:500]), ("de", "der die das und nicht ist ein eine " * 9)])
OPERATORS = {
    "quality": (lambda s, d: quality_rules.judge_quality(d, labels(s)), "all"),
    "language": (lambda s, d: language_id.identify(d, MODEL), "all"),
    "decontamination": (lambda s, d: decontaminate.find_items(d, items(s)), "all"),
    "decontamination in passes": (lambda s, d: decontaminate.find_items(d, items(s).unionByName(items(s).withColumn("item_id", F.lit(2).cast("long"))), 10), "all"),
    "pieces": (lambda s, d: pieces.encode_documents(d, path("piece_bpe_32k.model")), "all"),
    "sharding": (lambda s, d: sharding.assign_shards(d.withColumn("n_bytes", F.octet_length("text").cast("long")), limit=3000).drop("n_bytes"), "all"),
    "suffixes": (lambda s, d: suffix_dedup.remove_repeats(d), "all"),
    "jaccard": (lambda s, d: jaccard_join.join_documents(d), "all"),
    "keep one": (lambda s, d: jaccard_join.keep_one(d), "some"),
    "secrets": (lambda s, d: secrets.find_secrets(d), "all"),
    "lines": (lambda s, d: line_spread.remove_lines(d, sites=2), "all"),
    "runs": (lambda s, d: word_runs.find_runs(d), "all"),
    "id files": (lambda s, d: token_files.written_ids(d, path("byte_bpe_50k.json")), "all"),
    "phrases": (lambda s, d: collocations.collocations(d, least=3), "none"),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(spark, name):
    operator, kept = OPERATORS[name]
    docs = frame(spark, ROWS)
    done = operator(spark, docs)
    assert len(set(done.columns)) == len(done.columns)
    rows = done.collect()
    if kept == "all":
        assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ROWS)
    # Repeated rows get equal results, but for places in a sequence and shards of a divided key.
    if name not in ("id files", "phrases", "sharding"):
        same = [tuple(r) for r in rows if r.doc_id == 5]
        assert len(same) in (1, 2) and len(set(same)) == 1
    for c in CLASHING:
        values = {r[c] for r in rows} if c in done.columns else set()
        if any(isinstance(v, str) and v.startswith("given ") for v in values):
            assert values == {f"given {c}"}
    empty = operator(spark, frame(spark, []).filter("doc_id = 0"))
    assert empty.count() == 0 and empty.columns == done.columns


def test_columns_that_pass_through_are_not_touched(spark):
    for name in ("language", "decontamination", "sharding", "lines", "keep one"):
        done = OPERATORS[name][0](spark, frame(spark, ROWS[:3]))
        held = [c for c in CLASHING if c in done.columns and done.filter(F.col(c).cast("string") == f"given {c}").count() == done.count()]
        assert len(held) >= len(CLASHING) - 6, (name, sorted(set(CLASHING) - set(held)))


# ---- fitted models


def test_quality_verdicts_by_hand(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    marks = {}
    for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect():
        if r.doc_id is not None and r.quality is not None:
            marks.setdefault(r.doc_id, []).append((r.quality, r.toxic or 0))
    trusted = {i for i, m in marks.items() if min(q for q, _ in m) == 1 and max(t for _, t in m) == 0}
    vocabulary, grams = Words(), {}
    for i, text in docs:
        words = (text or "").encode().split()
        grams[i] = quality_rules.buckets(vocabulary.numbers(words), vocabulary.hashes).tolist() if words else []
    corpus = Counter(b for g in grams.values() for b in g)
    good = Counter(b for i, g in grams.items() if i in trusted for b in g)
    buckets, n, m = quality_rules.BUCKETS, sum(corpus.values()), sum(good.values())
    prior = quality_rules.PRIOR * buckets

    def ratio(b):
        raw = (corpus[b] + 1) / (n + buckets)
        return math.log((good[b] + prior * raw) / (m + prior)) - math.log(raw)

    scores = {i: sum(map(ratio, g)) / len(g) if g else 0.0 for i, g in grams.items()}
    failed = {i: brute.base(t)[5] for i, t in docs}
    found = sorted(scores[i] for i in scores if i in trusted and not failed[i])
    low = np.quantile(found, quality_rules.MISSED)
    threshold = low - quality_rules.ROOM * (np.median(found) - low)
    got = {r.doc_id: r for r in QUERIES["op1_quality_rules"](spark, sf_dir).collect()}
    for i, _ in docs:
        assert got[i].score == pytest.approx(scores[i], abs=1e-9) and got[i].threshold == pytest.approx(threshold, abs=1e-9)
        if abs(scores[i] - threshold) > 1e-9:
            assert got[i].kept == (not failed[i] and scores[i] >= threshold)


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules.judge_quality(frame(spark, ROWS), none).collect()
    assert all(r.kept == (not r.base_failed) for r in got)


def test_nearest_centroids_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit_documents(docs)
    table = language_id.letter_table()
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    for r in docs.orderBy("doc_id").limit(60).collect():
        counts, n = language_id.features(r.text or "", table)
        if not n:
            assert got[r.doc_id].lang_pred == "und"
            continue
        x = [math.log1p(c) * float(w) for c, w in zip(counts, model.idf)]
        norm = math.sqrt(sum(v * v for v in x))
        similar = [sum(a * float(b) for a, b in zip(x, v)) / norm for v in model.vectors]
        best = max(similar)
        near = [lang for lang, s in zip(model.langs, similar) if s > best - 1e-5]
        assert got[r.doc_id].lang_pred in near and got[r.doc_id].score == pytest.approx(best, abs=1e-4)
        judged = n >= language_id.MIN_LETTERS and abs(best - model.least[similar.index(best)]) > 1e-4
        if judged:
            assert got[r.doc_id].rejected == (best < model.least[similar.index(best)])


def test_a_foreign_text_is_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit_documents(docs)
    foreign = "ეს არის ტექსტი უცნობ ენაზე და არავის ესმის მისი " * 5
    rows = spark.createDataFrame([(1, foreign), (2, "qxz zxq wqx jjk kkj xxq " * 9), (3, foreign[:20])], "doc_id long, text string")
    got = {r.doc_id: r.rejected for r in language_id.identify(rows, model).collect()}
    assert got[1] and got[2] and not got[3]


def test_equally_near_centroids_and_the_same_model_in_any_order(spark):
    twins = language_id.fit([("bb", "lala lolo " * 9), ("aa", "lala lolo " * 9)])
    rows = spark.createDataFrame([(1, "lala lolo")], "doc_id long, text string")
    assert language_id.identify(rows, twins).first().lang_pred == "aa"
    texts = [(i, f"word{i % 7} text number {i} of many", "xx" if i % 2 else "yy") for i in range(80)]
    one = language_id.fit_documents(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    two = language_id.fit_documents(spark.createDataFrame(texts[::-1], "doc_id long, text string, lang string").repartition(5))
    assert one.langs == two.langs and np.allclose(one.vectors, two.vectors) and np.allclose(one.least, two.least)
    assert language_id.fit_documents(spark.createDataFrame([(1, None, "x"), (2, "a", None), (3, "1", "x")], "doc_id long, text string, lang string")) is None


def test_quality_fitted_on_every_trusted_document(spark):
    """More trusted documents than a sample would hold (20,000): the threshold is that of all their scores."""
    words = F.concat_ws(" ", *[F.concat(F.lit(f"w{i}-"), F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(40))) for i in range(52)])
    documents = spark.range(24_000).select(F.col("id").alias("doc_id"), words.alias("text"))
    labels = documents.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality_rules.bucket_counts(documents, quality_rules.trusted_labels(labels))[1].sum() == 24_000 * (52 + 51)
    got = quality_rules.judge_quality(documents, labels).select("score", "threshold").collect()
    scores = [r.score for r in got]
    low = np.quantile(scores, quality_rules.MISSED)
    assert math.isclose(got[0].threshold, low - quality_rules.ROOM * (np.median(scores) - low), rel_tol=1e-12)


def test_values_at_places(spark):
    rows = [(-1.5, 3), (0.0, 1), (1e-300, 2), (0.25, 1_000_000), (0.25000000000000006, 4), (7.0, 1)]
    counted = spark.createDataFrame(rows, "v double, n long")
    places = [0, 2, 3, 4, 5, 6, 1_000_005, 1_000_006, 1_000_010]
    want = [-1.5, -1.5, 0.0, 1e-300, 1e-300, 0.25, 0.25, 0.25000000000000006, 7.0]
    assert quality_rules.values_at(counted, places) == dict(zip(places, want))
