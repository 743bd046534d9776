"""Lexical search, language identification and resampling on hard rows, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sleuthframe.llm import language_id, lexical_search, resampling
from sleuthframe.llm.ascii_words import WINDOW, Words, windows

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["The cat, the CAT & the hat", "", None, "...", "Ünlü ÜNLÜ ünlü_x 12a", "a\x00b\x7fc", "日本語 日本", "cat " * 700, "cat", "cat", "hat " * 3 + "İ", "x" * 5000, "the"]


def terms(text):
    return [t.translate(LOW) for t in TERM.findall(text or "")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t, "en", "x", 1, 2, "y") for i, t in enumerate(TEXTS)] + [(8, "cat", "en", "x", 1, 2, "y"), (8, "dog cat", "en", "x", 1, 2, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id string, q long, rank long, term string").repartition(3)


def test_words_of_columns():
    for column in (pa.array(TEXTS, pa.string()), pa.array(["drop", *TEXTS], pa.string()).slice(1), pa.array([], pa.string())):
        words = Words(column)
        found = words.texts.take(pa.array(words.code)).to_pylist()
        assert [[w.decode() for w in found[a:b]] for a, b in zip(words.first[:-1], words.first[1:], strict=True)] == [terms(t) for t in column.to_pylist()]


def test_windows_lose_no_word():
    text = "ab cde " * 40 + "z" * 300 + " é" * 30
    for most in (1, 5, 64, WINDOW):
        parts = list(windows(pa.array([None, text, "a b"], pa.string()), most))
        got = Counter()
        for at, n, part in parts:
            words = Words(part)
            for i, code in zip(words.owner(), words.code, strict=True):
                assert i < n
                got[at + i, words.texts[code].as_py().decode()] += 1
        assert got == Counter((i, t) for i, x in enumerate([None, text, "a b"]) for t in terms(x))


def ranked(docs, items, k):
    """Each item's best documents, by the formula."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, length = len(bags), sum(s for *_, s in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag, size in bags:
            m = 75 + (25 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms(text) if bag[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "the cat"), (1, "CAT cat hat"), (None, "ünlü"), (3, None), (4, "!!"), (5, "日本 b 12a"), (6, "nothing here"), (7, "x" * 5000)]


@pytest.mark.parametrize(("k", "block", "piece", "few"), [(20, 500_000, WINDOW, 200_000), (3, 2, 40, 200_000), (2, 500_000, 1, 0)])
def test_search_is_exact(spark, docs, monkeypatch, k, block, piece, few):
    monkeypatch.setattr(lexical_search, "BROADCAST_TERMS", few)
    items = spark.createDataFrame([(i, t, 1, 2) for i, t in ITEMS], "item_id long, text string, q long, n long")
    postings, n = lexical_search.index(docs, piece=piece)
    got = lexical_search.search(postings, n, items, k=k, block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranked([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS, k)


def test_search_in_empty_tables(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none, n = lexical_search.index(docs.filter("false"))
    assert n == 0 and lexical_search.search(none, n, items).collect() == []
    postings, n = lexical_search.index(docs)
    assert lexical_search.search(postings, n, items.filter("false")).collect() == []


def test_search_by_ids_of_text(spark):
    docs = spark.createDataFrame([("b", "cat"), ("a", "cat"), (None, "cat"), ("c", "dog cat")], "doc_id string, text string")
    postings, n = lexical_search.index(docs)
    got = lexical_search.search(postings, n, spark.createDataFrame([("q", "dog")], "item_id string, text string"), k=2)
    assert [tuple(r)[:3] for r in got.orderBy("rank").collect()] == [("q", 1, "c")]


def test_long_text_counts_in_windows(monkeypatch):
    monkeypatch.setattr(lexical_search, "windows", lambda column: windows(column, 16))
    column = pa.array(["cat the " * 9, "", "the", None], pa.string())
    words, code, doc, tf, n = lexical_search.counted(column)
    assert {(words[c].as_py(), d): t for c, d, t in zip(code, doc, tf, strict=True)} == {(b"cat", 0): 9, (b"the", 0): 9, (b"the", 2): 1}
    assert n.tolist() == [18, 0, 1, 0] and list(zip(code, doc, strict=True)) == sorted(zip(code, doc, strict=True))


def test_top_is_safe_for_ties():
    import numpy as np

    assert lexical_search.top(np.array([0, 3, 5, 3, 3, 0]), 3).tolist() == [2, 1, 3]
    assert lexical_search.top(np.array([0, 0]), 3).tolist() == []
    assert sorted(lexical_search.top(np.array([1, 2, 0]), 3).tolist()) == [0, 1]


def drawn(docs, target, order, buckets, share, least):
    """Rows of resampled(), by the formulas; words are terms."""
    def bag(text):
        w = terms(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(w) - n + 1)]

    bags = [(i, bag(t), len(terms(t))) for i, t in docs]
    s, t = Counter(b for _, f, _ in bags for b in f), Counter(b for x in target for b in bag(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, f, words in bags:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: len(able) * share // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize(("order", "chunk", "share", "least"), [(1, 65_536, 10, 20), (1, 32, 60, 1), (3, 32, 60, 2), (2, 1, 100, 0)])
def test_resampling_is_exact(spark, docs, order, chunk, share, least):
    target = spark.createDataFrame([("the cat the hat", 1), (None, 2), ("CAT dog " * 30, 3)], "text string, id long")
    got = resampling.resampled(docs, target, order=order, buckets=50, chunk=chunk, share=share, least_words=least)
    want = drawn([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], order, 50, share, least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_resampling_of_empty_tables(spark, docs):
    target = spark.createDataFrame([("the cat", 1)], "text string, id long")
    assert resampling.resampled(docs.filter("false"), target).collect() == []
    assert resampling.resampled(docs, target.filter("false")).count() == docs.count()


def test_chunks_own_their_starts(spark):
    text = "one two three four five six seven " * 20
    df = spark.createDataFrame([(1, text), (1, text), (2, "." * 500), (3, "w" * 300), (4, "short")], "id long, text string")
    short, long = resampling.chunks(df, order=3, chunk=40)
    assert [r["id"] for r in short.collect()] == [4]
    rows = long.collect()
    for i, copies, words in ((1, 2, 140), (2, 1, 0), (3, 1, 1)):
        own = [r for r in rows if r["id"] == i]
        assert sum(r["owned"] for r in own) == copies * words and sum(r["head"] for r in own) == copies
        assert all(len(terms(bytes(r["text"]).decode())) <= r["owned"] + 2 for r in own)


def test_language_accuracy(spark):
    got = language_id.op12_language_id(spark, SF).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(1, "the dog and the cat", "en"), (2, "der Hund und die Katze", "de"), (3, "le chien et le chat", "fr"), (4, None, "en"), (5, "no language", None), (6, "Das Haus und der Garten", "de"), (None, "the house", "en")]
    return language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))


def scores(model, text):
    """-log10 means, word by word, by the definition."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    out = []
    for k in range(len(model.languages)):
        total = 0.0
        for w in words:
            if w in model.words:
                total += 7.0 - dict(model.words[w]).get(k, 0.0)
                continue
            for n in range(5, 0, -1):
                grams = [g for i in range(len(w) + 3 - n) if (g := f" {w} "[i : i + n]) in model.grams]
                if grams:
                    total += 7.0 - sum(dict(model.grams[g]).get(k, 0.0) for g in grams) / len(grams)
                    break
            else:
                total += 7.0
        out.append(total / max(1, len(words)))
    return out


def test_language_backs_off_word_first(model):
    assert model.languages == ["de", "en", "fr"]
    texts = ["the cat", "Katzen", "chiens", "dogs UND houses und", "zzz", "q", "le Hund " * 500]
    count, saved = model.means(pa.array(texts, pa.string()))
    for text, n, own in zip(texts, count, saved, strict=True):
        assert n == len(text.split()) and 7.0 - own == pytest.approx(scores(model, text))


def test_language_of_odd_rows(spark, model):
    rows = [(1, "the dog", "x", 1), (1, "the dog", "x", 1), (2, None, "x", 1), (3, "", "x", 1), (4, "12 !! \x00", "x", 1), (None, "der Hund", "x", 1), (5, "语言", "x", 1), (6, "the " * 200_000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = [tuple(r) for r in language_id.identified(df, model).collect()]
    assert [g[:2] for g in got] == [(1, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "und"), (None, "de"), (5, "de"), (6, "en")]
    assert all(g[2] == 0 for g in got if g[1] == "und") and got[6][2] == pytest.approx(1 / 3)
    assert language_id.identified(df.filter("false"), model).collect() == []
    none = language_id.learn(df.filter("false"), F.lit(True))
    assert {r["lang_pred"] for r in language_id.identified(df, none).collect()} == {"und"}


def test_language_of_bytes_that_are_not_text(spark, model):
    df = spark.sql("SELECT 1L AS doc_id, CAST(unhex('74686520646F67FF') AS STRING) AS text")
    assert language_id.identified(df, model).first()["lang_pred"] == "en"
