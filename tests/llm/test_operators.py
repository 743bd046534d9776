"""Each operator on hard rows, against brute force or an exact round trip."""

import hashlib
import io
import math
import os
import re
import zipfile
import zlib
from collections import Counter
from itertools import accumulate

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sleuthframe.llm import queries, warc_zip
from sleuthframe.llm.components import components
from sleuthframe.llm.decontamination import contained_items, without_items
from sleuthframe.llm.main_text import extract, features, main_text, parse, site_nodes
from sleuthframe.llm.mixing import mixing_plan, training_documents
from sleuthframe.llm.nearest import nearest, op5_nearest
from sleuthframe.llm.ngram_join import band_plan, ngram_join, one_of_each
from sleuthframe.llm.pii import personal_data
from sleuthframe.llm.shingles import shingles, text_keys
from sleuthframe.llm.token_counts import token_counts
from sleuthframe.llm.token_files import FrameReader, FrameWriter, read_token_files, write_token_files
from sleuthframe.llm.common import dealt_join, shared_folder
from sleuthframe.llm.toxicity import Automaton, Lexicon, Model, held_out, learn, op1_toxicity, toxicity

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "it's I'll they'RE ''s 'sfoo 'llx 's", "a"), (2, "a<|endoftext|>b <|ENDOFTEXT|>", "a"), (3, "Σας ΟΔΟΣ İstanbul", "b"), (4, "日本語 текст 12345 ½²", "b"),
    (5, "é café", None), (6, "\x00\x1c a\x85b", "b"), (7, "x" * 50_000, "a"), (8, "   \n\t ", "a"), (9, "", "a"), (10, None, "c"),
    (11, "don't'''ve #!$%^ 12,000.50 — “quotes”…", "a"), (12, "a  b   c\n\n d\t e  ", "a"), (12, "a  b   c\n\n d\t e  ", "a"), (None, "no id at all", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, "x", 1, 2) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id string, n long, key long")


def empty(df):
    return df.filter("false")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got, want = queries.QUERIES[name](spark, SF), c.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(x) for x in columns]
    assert sorted((tuple(r[x] for x in columns) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_token_counts_equal_the_library(spark, odd):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(((i or -1), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ODD)
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in token_counts(odd).collect()) == want
    assert token_counts(empty(odd)).collect() == []


def test_token_files_round_trip(spark, odd):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = read_token_files(write_token_files(odd, shared_folder(spark))).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, *sorted(i for i, _, _ in ODD if i is not None)]
    want = sorted((i or -1, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in ODD)
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == want
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    assert read_token_files(write_token_files(empty(odd), shared_folder(spark))).collect() == []


def test_frames_are_read_alone_and_checked():
    out = io.BytesIO()
    frames = FrameWriter(out)
    for i in range(50):
        frames.add(i, np.arange(i, dtype=np.uint32))
    frames.finish()
    raw = bytearray(out.getvalue())
    reader = FrameReader(pa.BufferReader(bytes(raw)))
    assert reader.by_id(37)[0].tolist() == list(range(37))
    raw[int(reader.offset[20]) + 10] ^= 1
    broken = FrameReader(pa.BufferReader(bytes(raw)))
    assert broken.document(19).tolist() == list(range(19))
    with pytest.raises(Exception):
        broken.document(20)


def _sets(texts):
    h, o = shingles(texts)
    return [set(h[a:b].tolist()) for a, b in zip(o[:-1], o[1:])]


def test_ngram_join_finds_what_brute_force_finds(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"], 60)) for _ in range(20)]
    texts = [*base, *base[:5], None, "", "...", "one two", "One, two!"]
    for t in base[:10]:
        for k in (1, 2, 4, 8):
            w = t.split()
            for j in rng.choice(60, k, replace=False):
                w[j] = "changed"
            texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, key long")
    sets = _sets(texts)
    links = [{j for j in range(len(texts)) if j != i and sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])} for i in range(len(texts))]
    got = {r["doc_id"]: r for r in ngram_join(docs).collect()}
    assert [got[i]["n_links"] for i in range(len(texts))] == [len(x) for x in links]
    for i in range(len(texts)):
        reach, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        assert got[i]["class_id"] == min(reach)
    assert {r["doc_id"] for r in one_of_each(docs).collect()} == {r["class_id"] for r in got.values()}
    assert ngram_join(empty(docs)).collect() == []


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 30) if k % 10 != 9] + [(5, 5)], "u long, v long")
    assert {r["node"]: r["root"] for r in components(edges).collect()} == {k: k // 10 * 10 for k in range(30)}
    assert components(empty(edges)).collect() == []


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_contained_items(spark, most):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    items = [" ".join(rng.choice(words, n)) for n in (5, 14, 30, 59)]
    docs = []
    for t in items:
        w = t.split()
        docs += [" ".join([*rng.choice(words, 2000), *w, *rng.choice(words, 2000)]), " ".join([*w[: len(w) // 2], "x", *w[len(w) // 2 :]])]
    docs += [None, "", "w1 w2"]
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id long, text string, item long")
    q = spark.createDataFrame([*((i, t) for i, t in enumerate(items)), (9, None), (None, "")], "item_id long, text string")
    a, b = _sets(docs), _sets(items)
    want = {(i, j) for i in range(len(docs)) for j in range(len(items)) if 10 * len(a[i] & b[j]) >= 8 * len(b[j])}
    assert {(r[0], r[1]) for r in contained_items(d, q, broadcast_shingles=most).collect()} == want and len(want) >= 4
    assert contained_items(empty(d), q).collect() == [] and contained_items(d, empty(q)).collect() == []


def test_personal_data(spark):
    text = "é mail a@b.co, x@y.z_w@q.rs card 4111 1111 1111 1111 no 4111 1111 1111 1112 ip 256.1.1.1 10.0.0.1.2 +1 (234) 567-8901 iban GB82 WEST 1234 5698 7654 32 ssn 123-45-6789, 987-65-4321" + "1" * 20_000 + "a" * 20_000
    docs = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, kind int")
    got = {r["doc_id"]: [(s["kind"], text[s["start"] : s["end"]]) for s in r["found"]] for r in personal_data(docs).collect()}
    assert got[1] == [("email", "a@b.co"), ("email", "x@y.z"), ("email", "_w@q.rs"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (234) 567-8901"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789")]
    assert got[2] == got[3] == []


def test_nearest_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    got = op5_nearest(spark, SF).collect()
    want = set()
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        want |= {(int(ids[q]), int(ids[j])) for j in np.argsort(-s, kind="stable")[:20]}
    assert len(want & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(want)
    assert sorted(r["rank"] for r in got if r["query_id"] == 0) == list(range(1, 21))


def _recall(spark, x, k=20):
    """Least number of rows of a query, and the share of the due ones found; every tenth row asks."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, F.col("vec_id") % 10 == 0, k).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for q in range(0, len(x), 10):
        s = x @ x[q]
        s[q] = -np.inf
        due = set(np.argsort(-s, kind="stable")[: min(k, len(x) - 1)].tolist())
        hits.append(len(due & got.get(q, set())) / len(due))
    return min(len(got.get(q, ())) for q in range(0, len(x), 10)), np.mean(hits)


def test_nearest_gives_all_of_few_candidates(spark):
    x = np.random.default_rng(8).normal(size=(15, 64))
    assert _recall(spark, x) == (14, 1.0)


def test_nearest_with_unequal_norms(spark, monkeypatch):
    from sleuthframe.llm import nearest as module

    monkeypatch.setattr(module, "SLICE", 64)  # so that the shells are hashed
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= 20
    x[100:250] *= 0.3
    least, recall = _recall(spark, x)
    assert least == 20 and recall >= 0.9


def test_nearest_completes_what_hashing_misses(spark, monkeypatch):
    from sleuthframe.llm import nearest as module

    monkeypatch.setattr(module, "SLICE", 16)
    x = np.random.default_rng(10).normal(size=(40, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id") % 10 == 0, tables=1, probes=1).groupBy("query_id").count().collect()
    assert sorted((r["query_id"], r["count"]) for r in got) == [(0, 20), (10, 20), (20, 20), (30, 20)]


def test_nearest_ties_and_bad_vectors(spark):
    rows = [(i, [1.0, 0.0], 0) for i in range(30)] + [(30, [0.0, 0.0], 0), (31, None, 0), (32, [None, 1.0], 0), (33, [float("nan"), 1.0], 0), (34, [2.0, 0.0], 0), (None, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, g int")
    got = [(r["vec_id"], r["score"]) for r in nearest(df, F.col("vec_id") == 3).orderBy("rank").collect()]
    assert got == [(34, 2.0)] + [(i, 1.0) for i in range(20) if i != 3]
    assert nearest(empty(df), F.col("vec_id") == 3).collect() == []


def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a>Menu</a></nav><div class="ad">Buy<article><header><h1>A &amp; B</h1></header><p>One <b>two
      three<p>four<br>five<script>var t="</p>";</script><div class=comments>six</div></article><footer>&copy; x</footer>"""
    assert extract(page) == "A & B One two three four five"
    assert extract("") == "" and extract("plain <i>te</i>xt") == "plain text" and extract("<p>a<p title='>'>b &lt;") == "a b <"


def test_main_text_drops_what_a_site_repeats(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div class=x>Same words here</div><div class=y>text {i}</div></body>") for i in range(20)] + [(90, None, None), (91, "odd", "<p>z")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == ("text 3", 6) and got[90] == ("", 0) and got[91] == ("z", 1)
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_main_text_keeps_articles_of_copied_pages(spark):
    def page(i, text):
        return (i, f"http://h.example/{i}", f"<body><div class=x>Same words here</div><article><p>{text}</p></article></body>")

    rows = [page(i, "one article") for i in range(45)] + [page(45 + i, f"other <b>same</b> text {i}") for i in range(10)]
    # without an article: 45 copies of one page beside 4 others, and a word that all pages of a host have in a sentence
    rows += [(100 + i, f"http://d.example/{i}", f"<body><div>text {max(0, i - 44)}</div></body>") for i in range(49)]
    rows += [(200 + i, f"http://e.example/{i}", f"<body><div>text <b>same</b> number {i}</div></body>") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == got[44] == "one article" and got[47] == "other same text 2"
    assert got[100] == "text 0" and got[148] == "text 4" and got[203] == "text same number 3"


def test_mixing_targets_and_order(spark, odd):
    plan = mixing_plan(odd).collect()
    sums = {}
    for r in plan:
        assert r["taken"] <= 3 * r["size"]
        t = sums.setdefault(r["source"], [r["target"], 0])
        t[1] += r["taken"]
    assert all(abs(a - b) <= 1 for a, b in sums.values())
    assert abs(sum(a for a, _ in sums.values()) - sum(r["size"] for r in plan)) < 1e-6
    assert training_documents(odd).columns == odd.columns and mixing_plan(empty(odd)).collect() == [] and training_documents(empty(odd)).collect() == []


def test_mixing_query_is_in_training_order(spark):
    rows = queries.QUERIES["op9_mixing"](spark, SF).collect()
    places = [(r["position"] is None, r["position"] or 0.0, r["doc_id"]) for r in rows]
    assert places == sorted(places) and any(r["position"] for r in rows)


@pytest.mark.parametrize("zip64", [False, True])
def test_warc_round_trip(spark, zip64):
    long, short = "ä" * 900, "s" * 10
    rows = [(1, "http://a\r\nX: y", long), (2, None, long), (7, "u", long), (3, "u", short), (4, "u", short), (5, "u", None), (None, "u", long), (9, "u", "\r\n\r\n<p>")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, target int")
    files = warc_zip.write_archives(pages, shared_folder(spark), zip64=zip64)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc_zip.read_archives(files).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = html == long and i != 7
        assert got[i] == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None)
    path = files.first()["file"].removeprefix("file:")
    assert zipfile.ZipFile(path).testzip() is None and set(zipfile.ZipFile(path).namelist()) == {warc_zip.RECORDS, warc_zip.INDEX}
    assert warc_zip.read_archives(warc_zip.write_archives(empty(pages), shared_folder(spark))).collect() == []


def test_automaton_and_trie():
    lexicon = Lexicon({("stupid", False): 2.0, ("vequ", True): 1.0, ("lowei", True): 3.0})
    assert lexicon.exact("stupid") == 2.0 and lexicon.exact("stupidly") == 0.0 and lexicon.exact("vequais") == 1.0
    for word in ("stupd", "stuppid", "stupyd", "xtupid", "stupi"):
        assert lexicon.fuzzy(word) == 2.0
    assert lexicon.fuzzy("stud") == 0.0 and lexicon.fuzzy("lowxischaft") == 3.0
    a = Automaton("kitten", 1)
    s = a.start()
    for c in "sitting":
        s = a.step(s, c)
    assert s[-1] == 3 and not a.accepts(s, beginning=False)


def test_toxicity_held_out(spark):
    rows = op1_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_without_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = learn(odd, labels)
    assert {r["score"] for r in toxicity(odd, model).collect()} == {0.0}
    scores = toxicity(odd, Model({("quotes", False): 1.0}, -1.0, (9.0, 0.0))).collect()
    assert len(scores) == len(ODD) and toxicity(empty(odd), model).collect() == []


def test_remembered_texts_are_compared():
    from sleuthframe.llm.common import Remembered, kept

    texts, asked = ["ab", "cd", "ab", "ef", "x" * 100, "x" * 100, "abc"], []
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    end = np.cumsum([len(t) for t in texts])
    begin, no = end - [len(t) for t in texts], np.zeros(7, bool)
    # all keys are equal, or the two that differ are swapped later on
    for keys in (np.zeros(7, np.uint64), np.array([1, 2, 1, 3, 4, 4, 1], np.uint64), np.array([2, 1, 2, 3, 4, 4, 9], np.uint64)):
        memory = Remembered(np.zeros(0, np.int64))

        def make(some, texts=texts):
            asked.append(len(some))
            return np.array([sum(map(ord, texts[i])) for i in some], np.int64)

        want = [sum(map(ord, t)) for t in texts]
        for _ in range(2):
            assert memory.values_of(keys, no, codes, begin, end, make).tolist() == want
        assert memory.values_of(np.roll(keys, 1), no, codes, begin, end, make).tolist() == want
        assert memory.values_of(keys[:0], no[:0], codes, begin[:0], end[:0], make).tolist() == []
    keys, exact = text_keys(codes, begin, end - begin)
    assert exact.tolist() == [True] * 4 + [False, False, True] and keys[0] == keys[2] and len(set(keys.tolist())) == 5
    memory = Remembered(np.zeros(0, np.int64))
    assert memory.values_of(keys, exact, codes, begin, end, make).tolist() == want == memory.values_of(keys, exact, codes, begin, end, make).tolist()
    made = [kept("a", list), kept("a", list), kept("b", dict), kept("a", list)]
    assert made[0] is made[1] and made[2] == {} and made[3] is not made[0]


def colliding(letters: int) -> tuple[str, str]:
    """Words that every polynomial hash modulo a power of two takes for one."""
    word = "".join("xe"[bin(i).count("1") % 2] for i in range(letters))
    return word, word.translate(str.maketrans("xe", "ex"))


@pytest.mark.parametrize("turn", [1, -1])
@pytest.mark.parametrize("letters", [64, 1024, 2048])
def test_words_of_equal_polynomial_hashes(spark, letters, turn):
    pair = colliding(letters)[::turn]
    docs = spark.createDataFrame([(i, " ".join([*"abcd", w, *"fghi"])) for i, w in enumerate(pair * 2)], "doc_id long, text string").coalesce(1)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert [r["n_tokens"] for r in token_counts(docs).orderBy("doc_id").collect()] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for t in texts]
    assert [r["ids_crc32"] for r in read_token_files(write_token_files(docs, shared_folder(spark))).orderBy("doc_id").collect()] == want
    assert [r["n_links"] for r in ngram_join(docs).orderBy("doc_id").collect()] == [1, 1, 1, 1]
    assert sorted(r[0] for r in contained_items(docs, docs.filter("doc_id = 1").withColumnRenamed("doc_id", "item_id")).collect()) == [1, 3]


def test_similar_texts_with_null_and_repeated_ids(spark):
    words = [f"w{k}" for k in range(60)]
    a, b, c = " ".join(words), " ".join([*words[:59], "zz"]), " ".join(reversed(words))
    schema = "doc_id long, text string, x int"
    for rows in ([(None, a, 0), (None, b, 0), (None, c, 0), (None, "", 0), (None, None, 1)], [(1, a, 0), (None, b, 0), (None, c, 0), (2, "", 0), (None, None, 0)]):
        docs = spark.createDataFrame(rows, schema)
        assert sorted(r["n_links"] for r in ngram_join(docs).collect()) == [0, 0, 0, 1, 1]
        stay = {(r["doc_id"], r["text"]) for r in one_of_each(docs).collect()}
        assert len(stay) == 4 and {r[:2] for r in rows[2:]} <= stay and len({(rows[0][0], a), (rows[1][0], b)} & stay) == 1
    # an id that repeats with another text, with a similar one, and row by row
    docs = spark.createDataFrame([(1, a, 0), (1, c, 0), (2, b, 0), (3, c, 1), (1, a, 7), (1, a, 0), (4, "", 0), (4, "", 0)], schema)
    stay = sorted(map(tuple, one_of_each(docs).collect()))
    assert [r[:2] for r in stay] == [(1, a), (1, c), (4, ""), (4, "")]
    assert stay == sorted(map(tuple, one_of_each(docs.repartition(3, "x")).collect()))
    gone = without_items(docs, spark.createDataFrame([(1, " ".join(words[10:40]))], "item_id long, text string"))
    assert sorted((r[0], r[1]) for r in gone.collect()) == [(1, c), (3, c), (4, ""), (4, "")]


def test_training_documents_keep_rows_without_an_id(spark):
    rows = [(None, "one two three", "a", 0), (None, "four five", "a", 0), (7, "six", "a", 0), (7, "seven eight", "a", 1), (7, "six", "a", 0), (8, None, "a", 0)]
    got = sorted((r["text"], r["x"]) for r in training_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, x int")).collect())
    assert got == sorted((r[1], r[3]) for r in rows[:5])


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_short_items_inside_long_documents(spark, most):
    docs = spark.createDataFrame([(1, "Paris is the capital of France, they say."), (2, "capital of france"), (3, "capital of"), (4, "a of capital France"), (None, "the CAPITAL of-France")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "capital of France"), (2, "Paris"), (3, "of capital france."), (4, "they say"), (5, "capital of france they say")], "item_id long, text string")
    got = sorted(((r[0] or 0), r[1], r[2]) for r in contained_items(docs, items, broadcast_shingles=most).collect())
    assert got == [(0, 1, 1.0), (1, 1, 1.0), (1, 2, 1.0), (1, 4, 1.0), (1, 5, 1.0), (2, 1, 1.0), (4, 3, 1.0)]


def test_band_plan():
    for similarity in (0.5, 0.8, 0.95):
        bands, rows = band_plan(similarity)
        assert 1 - (1 - similarity**rows) ** bands >= 1 - 1e-6 and bands * rows <= 128
    assert band_plan(0.8) == (27, 4)


def test_nearest_ties_of_different_vectors(spark):
    # 200 vectors, all with inner product 1 with the query
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [1.0, float(i % 20), float(i // 20)]) for i in range(200, 0, -1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == list(range(1, 21))


def test_nearest_recall_of_hashed_groups(spark, monkeypatch):
    from sleuthframe.llm import nearest as module

    monkeypatch.setattr(module, "SLICE", 256)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(10, 32))[rng.integers(0, 10, 6000)] + 1.5 * rng.normal(size=(6000, 32))
    least, recall = _recall(spark, x[:6000] / np.linalg.norm(x, axis=1, keepdims=True))
    assert least == 20 and recall >= 0.9


def test_cross_polytope_places():
    from sleuthframe.llm.nearest import filed_under, functions_needed, looked_under

    assert [functions_needed(n, 64) for n in (1, 4096, 4097, 4096 * 128, 4096 * 128 + 1)] == [1, 1, 2, 2, 3]
    x = np.random.default_rng(2).normal(size=(50, 16))
    for functions in (1, 2, 3):
        group, axis = filed_under(x, 3, functions)
        groups, axes = looked_under(x, 3, functions, 30)
        # a vector looks first where it is filed itself
        assert (groups[:, 0] == group).all() and (axes[:, 0] == axis).all()
        assert all(len(set(zip(g, a))) == 30 for g, a in zip(groups.tolist(), axes.tolist()))


def plain_spans(text):
    """The base kinds by their plain definition."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def right(kind, m):
        digits = [int(c) for c in m if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(kind, m.start(), m.end()) for kind, p in patterns.items() for m in re.finditer(p, text) if right(kind, m[0])]


def test_personal_data_equals_the_plain_definition(spark):
    rng = np.random.default_rng(6)
    parts = ["a@b.co", "x.y@z", "@", "4111 1111 1111 1111", "10.0.0.1", "1.2.3.4.5.6.7.8", "+1 (234) 567-8901", "+12345678", "é", " ", "-", ".", "12", "tel ", "ссылка "]
    texts = ["".join(rng.choice(parts, n)) for n in [*rng.integers(0, 60, 150), 3000, 5000]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in personal_data(docs).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["found"] if s["kind"] in ("email", "ip", "card", "phone")] == plain_spans(texts[r["doc_id"]])


def test_words_before_a_match_raise_its_score(spark):
    text = "ssn 123-45-6789 " + "a@b.co," * 30 + "987-65-4321 a@b.co ... contact: c@d.ee"
    got = {(s["kind"], text[s["start"] : s["end"]]): s["score"] for s in personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["found"]}
    assert got["ssn", "123-45-6789"] == 0.5 and ("ssn", "987-65-4321") not in got
    assert got["email", "c@d.ee"] == 1.0 and got["email", "a@b.co"] == 0.8


ARTICLES = {
    "readers' comments": ("<article><p>Text.</p></article><div id=comments><article class=comment-body><p>First!</p></article></div>", "Text."),
    "comment by its own name": ("<article><p>Text.</p></article><article class='comment'>First!</article>", "Text."),
    "teaser": ("<main><p>Text.</p></main><aside><article class=card>Read this</article></aside>", "Text."),
    "body's name": ("<body class=has-sidebar><p>Text.</p></body>", "Text."),
    "what it lacks": ("<div class='content no-sidebar'><p>Text.</p><div class=sidebar-left>Side</div></div>", "Text."),
    "its own header": ("<div class=article-header><h1>Title</h1></div><p>Text.</p><div class=site-header>Site</div>", "Title Text."),
    "capitals": ("<p>Text.</p><div class=siteFooter>x</div><div class=shareButtons>y</div><p class=address>Street</p>", "Text. Street"),
    "left open": ("<div class=ad>Buy<article><p>Text.</p></article>", "Text."),
    "comments in an article": ("<article><p>Text.<section id=reply-list><p>Me too</section></article>", "Text."),
}


@pytest.mark.parametrize("case", ARTICLES)
def test_whose_article_it_is(case):
    assert extract(ARTICLES[case][0]) == ARTICLES[case][1]


def plain_importance(pages):
    """Importance of every branch of one site's tree, by its definition."""
    distinct = {tuple(sorted(features(parse(h)).items())) for h in pages}
    own = {}
    for node in {n for p in distinct for n, _ in p}:
        seen = [dict(p)[node] for p in distinct if node in dict(p)]
        n = len(seen)
        entropy = -sum(k / n * math.log(k / n) for k in Counter(seen).values())
        own[node] = ((entropy / math.log(n) if n > 1 else 1.0) * n + 2) / (n + 2)
    paths = {"/".join(n.split("/")[:k]) for n in own for k in range(1, n.count("/") + 2)}
    return {p: max(v for n, v in own.items() if n == p or n.startswith(p + "/")) for p in paths}


def test_style_tree_equals_its_definition(spark):
    rng = np.random.default_rng(4)
    pages = [f"<body><div class=top>Site{' beta' * (i % 7 == 0)}</div><ul>{''.join('<li>x' for _ in range(rng.integers(1, 4)))}</ul><div class=c><p>{rng.integers(0, 9)}<p>fixed</div></body>" for i in range(40)]
    df = spark.createDataFrame([("h", p) for p in [*pages, *pages[:9]]] + [("g", "<p>a")] * 30, "host string, html string").repartition(3)
    got = {(r["host"], r["node"]): r["importance"] for r in site_nodes(df).collect()}
    want = {("h", n): v for n, v in plain_importance(pages).items()} | {("g", n): v for n, v in plain_importance(["<p>a"]).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(accumulate(range(len(b)), lambda left, j: min(left + 1, row[j + 1] + 1, row[j] + (x != b[j])), initial=i))
    return row[-1]


def test_fuzzy_terms_equal_all_distances():
    rng = np.random.default_rng(1)
    terms = {("stupid", False): 3.0, ("idiot", False): 2.5, ("morons", False): 2.0, ("pathet", True): 1.5, ("loser", True): 1.0, ("scum", False): 9.0}
    lexicon = Lexicon(terms)
    for _ in range(4000):
        word = list(rng.choice(["stupid", "idiot", "morons", "pathetic", "losers", "scum"]))
        for _ in range(rng.integers(0, 3)):
            k = rng.integers(0, len(word) + 1)
            word[k : k + rng.integers(0, 2)] = rng.choice(list("stupidoe1"), rng.integers(0, 2)).tolist()
        word = "".join(word)
        want = max((w for (t, beginning), w in terms.items() if len(t) >= 5 and min(distance(t, word[:n]) for n in (range(len(word) + 1) if beginning else [len(word)])) <= 1), default=0.0)
        assert lexicon.fuzzy(word) == want, word


def test_quotation_scores_below_abuse(spark):
    model = Model({("idiot", False): 2.0}, -2.0, (2.0, 2.0))
    texts = ["you are an idiot", "what an idiot", 'she said "idiot" again', "nothing here", "you are an idiiot", "you are an id1ot", "you are an id ot"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = [r["score"] for r in toxicity(docs, model).orderBy("doc_id").collect()]
    assert score[0] > score[1] > score[2] > score[3] and score[4] == score[5] > score[6] == score[3]


def test_null_ids_are_not_held_out(spark):
    assert [r[0] for r in spark.createDataFrame([(None,), (1,)], "doc_id long").select(held_out(F.col("doc_id"))).collect()][0] is False


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {"spark.checkpoint.dir": None}
        sparkContext = Context()

    Session.conf = type("Conf", (), {"get": lambda self, k, d=None: d})()
    with pytest.raises(ValueError):
        shared_folder(Session())


def test_dealt_join(spark):
    left = spark.createDataFrame([(k, "hot" if k % 3 else str(k)) for k in range(300)] + [(900, None), (901, "none")], "id long, key string")
    right = spark.createDataFrame([("hot", 1), ("0", 2), ("3", 3)], "key string, v int")
    for most in (10, 1000):
        for how in ("left", "inner"):
            got = sorted(map(tuple, dealt_join(left, right, "key", "id", how, most).select("id", "key", "v").collect()))
            assert got == sorted(map(tuple, left.join(right, "key", how).select("id", "key", "v").collect()))
