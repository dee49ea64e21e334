"""Operators that judge each text by itself: brute force, the library, held-out accuracy, odd rows."""

import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from contactloom.llm import decontaminate, language_id, pieces, quality_rules, secrets
from contactloom.llm.registered import QUERIES

from . import brute

ODD = [None, "", " ", "\n\n", "one", "A b", "x " * 700, "ab\n" * 300, "é ü ß " * 30, "Token = 'abcdef1'", "a" * 100_000, "the same", "the same"]


@pytest.fixture(scope="module")
def small(sf_dir):
    return duckdb.connect().execute(f"SELECT doc_id, text, lang FROM '{sf_dir}/documents.parquet'").fetchall()


def frame(spark, texts, extra=True):
    rows = [(i, t, "en", "s", 1.0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_hit double")
    return docs if extra else docs.select("doc_id", "text")


def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_base_counts(spark, sf_dir, small):
    got = {r[0]: tuple(r[1:7]) for r in QUERIES["op1_quality_rules"](spark, sf_dir).collect()}
    assert got == {i: brute.base(t) for i, t, _ in small}


def test_quality_keeps_trusted_and_drops_junk(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = QUERIES["op1_quality_rules"](spark, sf_dir).join(labels, "doc_id").filter("not base_failed and toxic = 0")
    kept = {r[0]: r[1] for r in judged.groupBy("quality").agg(F.avg(judged.kept.cast("double"))).collect()}
    assert kept[1] > 0.95 and kept[0] < 0.2


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, None), (None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    for texts in (ODD, []):
        got = quality_rules.judge_quality(frame(spark, texts), labels).orderBy("doc_id").collect()
        assert [tuple(r[1:7]) for r in got] == [brute.base(t) for t in texts]


def test_language_held_out_accuracy(spark, sf_dir, small):
    truth = {i: lang for i, _, lang in small}
    rows = QUERIES["op2_language_id"](spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    judged = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in judged) >= 0.97 * len(judged)
    assert sum(r.rejected for r in rows) <= 0.02 * len(rows)


def test_language_odd_rows(spark):
    model = language_id.fit([("aa", "lala lolo " * 9), ("bb", "xyz wxy " * 9), ("bb", "!!")])
    got = language_id.identify(frame(spark, [None, "", "12 !", "lalo", "zzz"]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got][:4] == ["und", "und", "und", "aa"]
    assert [r.score for r in got][:3] == [0, 0, 0] and got[0].rejected and not got[3].rejected
    assert language_id.fit([]) is None and language_id.fit([("aa", "1")]) is None
    assert [r.lang_pred for r in language_id.identify(frame(spark, ["a"]), None).collect()] == ["und"]
    assert language_id.identify(frame(spark, []), model).count() == 0


def test_decontamination(spark, sf_dir, small):
    items = duckdb.connect().execute(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op3_decontamination"](spark, sf_dir).collect()}
    sample = [r for r in small if got[r[0]][1]] + random.Random(1).sample(small, 15)
    for i, t, _ in sample:
        assert got[i] == brute.decontaminated(t, items)


def test_decontamination_short_items_blocks_and_odd_rows(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "é", "C", "7"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 13, 14, 30])][1:]
    items += [(8, None), (9, "..."), (None, "a b"), (5, "b a b b a")]
    texts = [" ".join(word() for _ in range(rng.randrange(60))) for _ in range(30)] + ODD[:8]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [brute.decontaminated(t, [x for x in items if x[0] is not None]) for t in texts]
    for most in (decontaminate.PASS_BYTES, 20):
        got = decontaminate.find_items(frame(spark, texts), bench, most).orderBy("doc_id").collect()
        assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == want
    assert decontaminate.find_items(frame(spark, texts), bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.find_items(frame(spark, []), bench).count() == 0


def test_pieces_equal_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    model, library = pieces.Pieces(model_path()), sentencepiece.SentencePieceProcessor(model_file=model_path())
    rng = random.Random(3)
    letters = "abcdeiort  \n\t▁.,é1290中😀\0"
    texts = [t or "" for t in ODD] + [" " * n + "x" for n in range(40)] + ["<s></s><unk><0x41>"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(3000)]
    for t in texts:
        ids = library.encode(t, add_eos=True)
        assert model.encode(t) == ids and model.decode(ids) == library.decode(ids)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(259), rng.randrange(32000), 28705]) for _ in range(rng.randrange(8))]
        assert model.decode(ids) == library.decode(ids)


def test_encode_documents(spark):
    model = pieces.Pieces(model_path())
    got = pieces.encode_documents(frame(spark, ODD), model_path(), keep_ids=True).orderBy("doc_id").collect()
    for r, t in zip(got, ODD):
        assert r.ids == model.encode(t) and r.n_tokens == len(r.ids) and r.decoded == (t or "")
        assert r.ids_sha256 == brute.sha(" ".join(map(str, r.ids))) and r.decoded_sha256 == brute.sha(t or "")
    assert pieces.encode_documents(frame(spark, []), model_path()).count() == 0


def test_secrets(spark, sf_dir, small):
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    digits, rest = "", zlib.crc32(body.encode())
    for _ in range(6):
        rest, d = divmod(rest, 62)
        digits = secrets.BASE62[d] + digits
    assert secrets.crc_ok((body + digits).encode()) and not secrets.crc_ok((body + digits[:-1] + "!").encode())
    made = f"é ghp_{body}{digits} ghp_{body}zzzzzz"
    texts = [made, "token=secret=abcdef token = 12345 PASSWORD:'a.b-c=d'", "AKIA" + "A" * 16 + " AKIAB", "ſecret=abcdefg toKen=abcdefg", "f" * 24 + "é" + "0" * 23, *ODD]
    got = secrets.find_secrets(frame(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r[1:5]) for r in got] == [brute.secrets(t) for t in texts]
    assert got[0].spans == "hosting:2:42"
    found = {r[0]: tuple(r[1:5]) for r in QUERIES["op9_secrets"](spark, sf_dir).collect()}
    assert found == {i: brute.secrets(t) for i, t, _ in small}
    assert secrets.find_secrets(frame(spark, [])).count() == 0
