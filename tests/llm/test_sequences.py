"""Word runs, Huffman-coded id files and phrase counts: brute force, round trips, the library, SQL, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from contactloom.llm import collocations, token_files, word_runs
from contactloom.llm.registered import QUERIES
from contactloom.llm.vocabulary import Words
from contactloom.session import new_path

from . import brute

LONG = "word " * 50_000
ODD = [None, "", " \n\t ", "one", "a b a b a b a b", "x " * 6, "x " * 5, LONG + "end", "same", "same", "é\x00 \x85 ß", "\x1c a  b \n c"]


def frame(spark, texts, first=0):
    rows = [(first + i, t, None if i % 3 == 0 else "en", 7, "r", 1.5, "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_runs int, ids string, score double, place string")


# ---- runs


def words_of(text):
    return (text or "").encode().split()


def slow_runs(words, least=4, shortest=6):
    """Every stretch that keeps a period, smallest period first."""
    seen, out = set(), []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if size >= 2 * q and (i, size) not in seen:
                seen.add((i, size))
                if size >= max(shortest, least * q):
                    out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text):
    w = words_of(text)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = slow_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return len(found), *top, brute.sha(listed), brute.sha(b" ".join(x for i, x in enumerate(w) if i not in gone))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        k = rng.choice([1, 2, 3, 4])
        noise = lambda n: [rng.randrange(k) for _ in range(rng.randrange(n))]
        words = noise(12) + (noise(6) or [0]) * rng.randrange(10) + noise(12) + noise(25)
        array = np.array(words, np.int64)
        assert (word_runs.runs(array, 2, 2) if words else []) == slow_runs(words, 2, 2)
        assert next(word_runs.runs_of([[b"%d" % x for x in words]], Words())) == slow_runs(words)


def test_runs_of_strings_full_of_runs():
    fibonacci, thue = ["a", "b"], ["a"]
    while len(fibonacci[-1]) < 600:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
        thue.append(thue[-1] + "".join({"a": "b", "b": "a"}[c] for c in thue[-1]))
    for text in (fibonacci[-1], thue[-1][:700], "a" * 500, "ab" * 300 + "a" * 9 + "ba" * 40, "aab" * 50 + "aabaab" * 9):
        array = np.array([ord(c) for c in text], np.int64)
        assert word_runs.runs(array, 2, 2) == slow_runs(list(text), 2, 2)


def test_a_long_loop_takes_time_in_proportion():
    array = np.zeros(60_000, np.int64)
    assert word_runs.runs(array) == [(0, 60_000, 1)]


def test_word_runs_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r[2:]) for r in QUERIES["op11_word_runs"](spark, sf_dir).collect()}
    assert got == {r.doc_id: slow_row(r.doc_id, r.text) for r in rows}
    assert sum(v[0] > 0 for v in got.values()) > 5


def test_word_runs_odd_rows(spark):
    texts = ODD * 4
    got = word_runs.find_runs(frame(spark, texts), loop=True).orderBy("doc_id").collect()
    assert [tuple(r[2:]) for r in got] == [slow_row(i, t) if t is None or len(t) < 1000 else tuple(got[i][2:]) for i, t in enumerate(texts)]
    found = word_runs.find_runs(frame(spark, ODD), spans=True).orderBy("doc_id").collect()
    assert [r.n_runs for r in found] == [0, 0, 0, 0, 1, 1, 0, 1, 0, 0, 0, 0]
    assert [tuple(x) for x in found[7].runs] == [(0, 50_000, 1)] and found[7].collapsed == "word end"
    assert found[4].collapsed == "a b" and found[4].exponent_milli == 4000 and found[3].start is None
    no_id = spark.createDataFrame([(None, "x " * 9), (None, None)], "doc_id string, text string")
    assert sorted(r.n_runs for r in word_runs.find_runs(no_id, loop=True).collect()) == [0, 1]
    assert word_runs.find_runs(frame(spark, [])).count() == 0


# ---- id files


def test_code_lengths_are_best_and_limited():
    rng = np.random.default_rng(0)
    for _ in range(60):
        counts = rng.integers(1, 1000, rng.integers(2, 40)) * rng.integers(0, 2, 1)[0] + rng.integers(1, 9)
        lengths = token_files.code_lengths(counts, 30).astype(int)
        assert sum(0.5**lengths) == 1
        heap, cost = sorted(counts.tolist()), 0
        while len(heap) > 1:
            both = heap.pop(0) + heap.pop(0)
            cost += both
            heap = sorted([*heap, both])
        assert (counts * lengths).sum() == cost
        short = token_files.code_lengths(counts, math.ceil(math.log2(len(counts)))).astype(int)
        assert sum(0.5**short) <= 1 and short.max() <= math.ceil(math.log2(len(counts)))
    fibonacci = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144])
    assert token_files.code_lengths(fibonacci, 5).max() == 5 and token_files.code_lengths(fibonacci, 30).max() == 11
    assert token_files.code_lengths(np.array([0, 7])).tolist() == [0, 1] and not len(token_files.code_lengths(np.zeros(0, np.int64)))


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_bits_round_trip(n):
    rng = np.random.default_rng(n)
    counts = (1e6 / np.arange(1, 400) ** 2).astype(np.int64) * (np.arange(399) % 5 != 3)
    code = token_files.Code(token_files.code_lengths(counts))
    ids = rng.choice(399, n, p=counts / counts.sum())
    words, offsets, bits = code.encode(ids)
    assert bits == int(code.lengths[ids].sum()) and len(offsets) == math.ceil(n / token_files.EVERY)
    assert (token_files.decode(words[: math.ceil(bits / 64)], offsets, n, code.table(), code.most) == ids).all()
    with pytest.raises(ValueError):
        code.encode(np.array([3]))


def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    return path, tokenizers.Tokenizer.from_file(path)


def test_tokens_equal_the_library():
    path, library = tokenizer()
    ours, rng = token_files.Tokens(path), random.Random(3)
    parts = [*" \n\t a b'sS.,é  \x1c\x85!12ß中😀_-", "<|endoftext|>", " the", "'ll", "  ", "\n\n", "word.Next", "x\ny"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(4000)]
    for text, ids, want in zip(texts, ours.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, ours.dtype).tolist() == want.ids, text


class Asked:
    """A tokenizer that counts the texts it is asked for."""

    def __init__(self, library):
        self.library, self.texts = library, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.library.encode_batch_fast(texts, **options)


def test_many_words_are_asked_for_together():
    path, library = tokenizer()
    ours, rng = token_files.Tokens(path), random.Random(4)
    ours.library = asked = Asked(ours.library)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(4, 24))) for _ in range(5000)]
    text = " ".join(words)
    (ids,) = ours.encode([text])
    assert np.frombuffer(ids, ours.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    assert asked.texts < 50
    before = asked.texts
    assert ours.encode([text[: len(words[0])] + " " + text]) and asked.texts - before < 10


def test_tokens_forgotten_and_asked_again(monkeypatch):
    path, library = tokenizer()
    monkeypatch.setattr(token_files, "REMEMBERED", 1 << 16)
    monkeypatch.setattr(token_files, "LOOKED_UP", 100)
    ours, rng = token_files.Tokens(path), random.Random(6)
    parts = [" wordword", "\x00", "\u00a0", "\u2003", "\u3000", "—", "×", "²", "\r\n", "'t", " 's", "мир", "<|endof", "<|endoftext|> ", "  \n", "1٣"]
    for _ in range(30):
        texts = ["".join(rng.choice(parts) + str(rng.randrange(10**9)) * rng.randrange(3) for _ in range(rng.randrange(12))) for _ in range(200)]
        for text, ids, want in zip(texts, ours.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(ids, ours.dtype).tolist() == want.ids, text
    assert ours.known.held() < 1 << 19
    assert ours.encode([]) == [] and ours.encode(["", ""]) == [b"", b""]


def expected_ids(rows):
    _, library = tokenizer()
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert [tuple(r) for r in QUERIES["op12_token_files"](spark, sf_dir).orderBy("doc_id").collect()] == expected_ids(rows)


@pytest.mark.parametrize("block", [1 << 17, 50])
def test_token_files_odd_rows(spark, monkeypatch, block):
    path, _ = tokenizer()
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    monkeypatch.setattr(token_files, "PART_BYTES", 200)
    rows = [(i - 3, t) for i, t in enumerate(ODD)] + [(None, "no id"), (2**40, "far")]
    docs = frame(spark, []).unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    target = new_path(spark, "test-ids")
    token_files.save_ids(docs, target, path)
    found = token_files.load_ids(spark, target)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in found.orderBy("start").collect()]
    assert got == expected_ids(rows)
    # One id that fills the table: its rows keep whole and apart.
    same = spark.createDataFrame([(5, f"t{i % 4}") for i in range(60)] + [(6, "z")], "doc_id long, text string")
    many = token_files.written_ids(same, path).orderBy("start").collect()
    assert many[-1].doc_id == 6 and [r.start for r in many[1:]] == list(np.cumsum([r.n_tokens for r in many])[:-1])
    assert token_files.written_ids(same.limit(0), path).count() == 0


def test_damaged_and_foreign_files(spark, tmp_path):
    path, _ = tokenizer()
    target = str(tmp_path / "ids")
    token_files.save_ids(frame(spark, ["some text", "more text"]), target, path)
    (tmp_path / "ids" / "part-lost.ids").write_bytes(b"of a task that was not committed")
    assert token_files.load_ids(spark, target).count() == 2
    for file in (tmp_path / "ids").glob("part-*.ids"):
        data = bytearray(file.read_bytes())
        data[-1] ^= 1
        file.write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        token_files.load_ids(spark, target).collect()


# ---- phrases


def test_filters_are_lossless():
    rng = np.random.default_rng(2)
    for k in (1, 2, 5):
        keys = [rng.integers(0, 5, 900).astype(np.uint64) for _ in range(k)]
        want = Counter(zip(*[x.tolist() for x in keys]))
        halves = [collocations.QuotientFilter.of(collocations.permuted([x[s] for x in keys])) for s in (slice(0, 300), slice(300, None))]
        found = Counter()
        for half in halves:
            for segment, n, data in half.segments():
                part = collocations.QuotientFilter.unpacked(segment, k, data)
                assert len(part) == n
                for key, count in zip(zip(*[x.tolist() for x in collocations.restored(part.lanes)]), part.counts.tolist()):
                    found[key] += count
        assert found == want
        whole = halves[0].merged(halves[1])
        assert whole.counts.sum() == 900 and (np.diff(whole.lanes[0].astype(object)) >= 0).all()
    x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    assert (collocations.unmixed(collocations.mixed(x)) == x).all()


def test_equal_first_lanes_stay_apart():
    lanes = [np.array([7, 7, 7, 7, 1], np.uint64), np.array([2, 1, 2, 1, 9], np.uint64)]
    found = collocations.QuotientFilter.of(lanes, np.array([1, 10, 100, 1000, 5]))
    assert [x.tolist() for x in found.lanes] == [[1, 7, 7], [9, 1, 2]] and found.counts.tolist() == [5, 1010, 101]


def test_counters_beyond_one_byte():
    keys = [np.repeat(np.array([3, 4], np.uint64), [254, 70_000])]
    whole = collocations.QuotientFilter.of(collocations.permuted(keys))
    parts = [collocations.QuotientFilter.unpacked(s, 1, d) for s, _, d in whole.segments()]
    assert sorted(int(c) for p in parts for c in p.counts) == [254, 70_000]


def slow_collocations(rows, least, longest, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in __import__("re").split(r"[.,;:!?\x0A-\x0D]", brute.lower(text)):
            words = __import__("re").findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    often = {g: f for g, f in counts.items() if f >= least}
    found = []
    for (lang, g), a in often.items():
        if len(g) < 2:
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, g[:c]] * counts[lang, g[c:]]), c) for c in range(1, len(g))]
        score, cut = min(cuts)
        longer = (h for (x, h), f in often.items() if x == lang and len(h) > len(g) and f >= a)
        if any(h[i : i + len(g)] == g for h in longer for i in range(len(h))):
            continue
        phrase = " ".join(g)
        found.append((lang, phrase, a, counts[lang, g[:cut]], counts[lang, g[cut:]], totals[lang], score, cut))
    out = []
    for lang in totals:
        own = sorted((r for r in found if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(own)]
    return sorted(out)


@pytest.mark.parametrize("held, numbered", [(1 << 24, 1 << 22), (600, 1 << 22), (600, 3)])
def test_collocations(spark, monkeypatch, held, numbered):
    monkeypatch.setattr(collocations, "HELD_BYTES", held)
    monkeypatch.setattr(collocations, "GATHERED", min(collocations.GATHERED, held))
    monkeypatch.setattr(collocations, "NUMBERED", numbered)
    monkeypatch.setattr(collocations, "COUNTED", numbered)
    rng = random.Random(6)
    word = lambda: rng.choice(["a", "b", "C", "é", "new", "York", "the", "\xff", "ſ"])
    texts = [" ".join(word() + rng.choice(["", "", "", ".", "\n", "\t", "!?"]) for _ in range(rng.randrange(80))) for _ in range(60)]
    texts += ["New York City of the"] * 40 + ODD[:4] + [LONG[:2000]]
    rows = [(t, rng.choice(["en", "de", None, "und"])) for t in texts]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, n int, id string, f int")
    got = collocations.collocations(docs, least=8, top=30)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut"] or set(got.columns) >= {"lang", "rank", "phrase"}
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut"]
    assert sorted(tuple(r) for r in got.select(names).collect()) == slow_collocations(rows, 8, 5, 30)


def test_collocations_of_little(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [None, "", "a b"])).count() == 0


def test_another_seed_where_ids_meet(spark, monkeypatch):
    docs = spark.createDataFrame([("a b a b c", "en")], "text string, lang string")
    one, seed = collocations.numbered_words(docs)
    assert seed == 0 and {r.word: r.f for r in one.collect()} == {"a": 2, "b": 2, "c": 1}
    counts = collocations.word_counts
    monkeypatch.setattr(
        collocations, "word_counts", lambda d, s: counts(d, s) if s else spark.createDataFrame([("en", "a", 1, 1), ("en", "b", 1, 1)], "lang string, word string, f long, id long")
    )
    assert collocations.numbered_words(docs)[1] == 1
