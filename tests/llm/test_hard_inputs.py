"""Inputs that earlier versions of the operators fell over."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sleuthframe.llm import decontamination
from sleuthframe.llm.common import filesystem
from sleuthframe.llm.decontamination import contained_items
from sleuthframe.llm.main_text import extract, features, parse
from sleuthframe.llm.nearest import nearest
from sleuthframe.llm.token_counts import PairMerger

ARTICLE = "<article><h1>T</h1><p>Some text of the page.</p></article>"
PAGES = {
    "wrapper with a fixed header": (f'<div class="wrapper header-fixed">{ARTICLE}</div>', "T Some text of the page."),
    "wrapper without an article": ('<div class="wrapper header-fixed"><p>Long text of the page here.</p><div class="site-footer">c</div></div>', "Long text of the page here."),
    "page with its sidebar on the right": (f'<div class="page sidebar-right">{ARTICLE}<div class="sidebar-right">x</div></div>', "T Some text of the page."),
    "layout without adverts": (f'<div class="layout ad-free">{ARTICLE}</div>', "T Some text of the page."),
    "social history": ('<article><section id="social-history"><p>Social things.</p></section></article>', "Social things."),
    "formula": ("<article><p>Let <math><mi>x</mi></math> be</p></article>", "Let x be"),
    "object": ("<article><p>A <object data=x>film</object> here</p></article>", "A film here"),
    "parts of forms": ("<article><p>A</p><select><option>one</select><textarea>two</textarea></article>", "A"),
    "source of a quotation": ("<article><p>A</p><blockquote>Q<footer>Who</footer></blockquote><footer>tags</footer></article>", "A Q Who"),
    "comments told by their heading": ("<main><article><p>A text</p></article><section><h2>Comments</h2><article class=c><p>nice</p></article></section></main>", "A text"),
    "comments counted in their heading": ("<article><p>A text</p><div><h3><span>12 Comments</span></h3><ul><li>nice</ul></div></article>", "A text"),
    "an article about comments": ("<article><section><h2>Comments</h2><p>In code, comments begin so.</p></section></article>", "Comments In code, comments begin so."),
    "noise by the last word that doesn't say where": ('<body><div class="acme-sidebar">x</div><p>Text</p><div class="related-posts"><a>o</a></div><div class="cookie-bar">ok</div></body>', "Text"),
    "long comments": ('<article>a</article><div class="comments-list"><article>a comment longer than the article</article></div>', "a"),
}


@pytest.mark.parametrize("case", PAGES)
def test_page(case):
    assert extract(PAGES[case][0]) == PAGES[case][1]


@pytest.mark.parametrize("page", ["<a" * 500_000, "a <b " * 200_000, "<" + "x" * 1_000_000, "if a <b then " * 80_000, '<a "' * 250_000 + ">", "<!--" * 250_000, "<script" * 140_000], ids=lambda p: p[:6])
def test_odd_markup_takes_linear_time(page):
    begin = time.perf_counter()
    extract(page)
    assert time.perf_counter() - begin < 2


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<div>" * 50_000 + "</p>" * 50_000, "<p><b>" * 50_000, "<div><h2>" * 50_000 + "Comments", "<li>" * 100_000], ids=lambda p: p[:9])
def test_deep_markup_takes_linear_time(page):
    begin = time.perf_counter()
    features(parse(page))
    assert time.perf_counter() - begin < 10


def exact(rows, queries, k):
    """The k nearest of each query by the definition; what isn't a number comes last."""
    ids, x, out = np.array([i for i, _ in rows]), np.array([v for _, v in rows]), {}
    for i, v in rows:
        if queries(i):
            with np.errstate(all="ignore"):
                score = (x * np.array(v)).sum(1)
            score = np.where(np.isnan(score), -np.inf, score)
            out[i] = [int(ids[j]) for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
    return out


def found(df, queries, k, **more):
    out = {}
    for r in nearest(df, queries, k, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_nearest_of_extreme_norms(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(30)]
    rows[3:8] = [(3, [1e-200, 0.0, 0.0, 0.0, 0.0, 0.0]), (4, [1e200] * 6), (5, [-1e200, 1e200, 0.0, 0.0, 0.0, 0.0]), (6, [5e-324, 0.0, 0.0, 0.0, 0.0, 0.0]), (7, [1.7e308] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, F.col("vec_id") % 3 == 0, 5) == exact(rows, lambda i: i % 3 == 0, 5)


@pytest.mark.parametrize("most", [1, 40])
def test_nearest_reaches_its_recall_with_few_probes(spark, most):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(9000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = exact(rows, lambda i: i % 300 == 0, 10), found(df, F.col("vec_id") % 300 == 0, 10, most_probes=most)
    assert np.mean([len({*got[q]} & {*want[q]}) / 10 for q in want]) >= 0.9


def test_token_counts_of_all_small_code_points():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, r = Tokenizer.from_file(path), PairMerger(path), random.Random(5)
    letters = [chr(c) for c in range(1, 0x250)]
    texts = ["İ!", "Ⱥb!", *letters, *(f"a{c}!{c}b" for c in letters), *("".join(r.choices([*letters, " ", "'", "s"], k=r.randint(1, 30))) for _ in range(5000))]
    library.no_truncation()
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.count(texts).tolist() == want


def test_decontamination_by_shuffling_compares_words(spark, monkeypatch):
    docs = [(1, "x y one two three four five six z"), (1, "x y one two three four five six z"), (None, "ONE, two three four five six"), (3, "one two three four"), (4, None), (5, "solo a b"), (6, "six five four three two one")]
    items = [(1, "one two three four five six"), (2, "solo"), (2, "solo"), (3, None), (None, "two three four five six")]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, k int").repartition(3)
    i = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, row int")
    want = sorted(map(repr, contained_items(d, i).collect()))
    assert len(want) == 8 and sorted(map(repr, contained_items(d, i, broadcast_shingles=0).collect())) == want
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 10)
    assert sorted(map(repr, contained_items(d, i).collect())) == want


def test_paths_of_object_stores():
    assert type(filesystem("file:/tmp/x")[0]).__name__ == "LocalFileSystem"
    try:
        fs, path = filesystem("s3a://bucket/a/b?region=us-east-1")
    except (ImportError, OSError):
        pytest.skip("this pyarrow has no S3")
    assert path == "bucket/a/b"
