import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from sleuthframe.llm.common import table, written
from sleuthframe.llm.decontamination import contained_items
from sleuthframe.llm.mixing import training_documents
from sleuthframe.llm.toxicity import learn
from sleuthframe.llm.toxicity import toxicity as scored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF))
        if name != "token_files":
            assert docs.columns == before.columns
        if name in ("toxicity", "near_duplicates", "decontamination"):
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        seen[name] = docs
    assert contained_items(seen["decontamination"], table(spark, SF, "benchmark")).count() == 0
    assert docs.count() == seen["mixing"].count() > 0
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_token_files_keep_the_order_of_the_mix(spark):
    mix = training_documents(table(spark, SF, "documents"))
    want = [r["doc_id"] for r in mix.collect()]
    assert want != sorted(want)
    files = corpus_pipeline.token_files(spark, written(mix), SF)
    assert [r["doc_id"] for r in files.orderBy("start").collect()] == want


def words_of(text):
    return [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()]


def shingled(text, n=5):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups(docs):
    """The least id of the group of similar texts that each document hangs together with."""
    sets, root = {i: shingled(t) for i, t, _ in docs}, {i: i for i, _, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def mixed(docs):
    """Ids in training order, by the plan's own words: sources in order weigh 1, 2, 3,
    repeating, no target is above three times its source, and weights change by -1/2,
    0 or 1/2 of themselves from the middle to the end."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    sources = sorted({s for _, _, s in docs if s is not None}) + [None] * any(s is None for _, _, s in docs)
    total = {s: sum(size[i] for i, _, x in docs if x == s) for s in sources}
    weight, open_, left, target = {s: k % 3 + 1 for k, s in enumerate(sources)}, set(sources), sum(total.values()), {}
    while True:
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * total[s]
        open_ -= set(over)
        left = sum(total.values()) - sum(target.values())
    for s in open_:
        target[s] = left * weight[s] / sum(weight[x] for x in open_)
    out = []
    for k, s in enumerate(sources):
        demand, slope, at = math.floor(target[s] + 0.5), (-0.5, 0.0, 0.5)[k % 3], 0
        for i, _, _ in sorted((d for d in docs if d[2] == s), key=lambda d: (hashlib.md5(str(d[0]).encode()).hexdigest(), d[0])):
            takes = math.ceil((demand - (at + size[i] / 2)) / total[s]) if size[i] else 0
            for n in range(max(0, takes)):
                share = min(1.0, (at + n * total[s]) / demand)
                out.append((share if slope == 0 else (math.sqrt((1 - slope) ** 2 + 4 * slope * share) - (1 - slope)) / (2 * slope), i))
            at += size[i]
    return [i for _, i in sorted(out)]


def test_pipeline_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    scores = {r["doc_id"]: r["score"] for r in scored(docs, learn(docs, table(spark, SF, "labels"))).collect()}
    left = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if scores[r["doc_id"]] < 0.5]
    assert 0 < len(left) < docs.count()
    first = groups(left)
    left = [d for d in left if first[d[0]] == d[0]]
    items = [(shingled(r["text"], min(5, len(words_of(r["text"])))), min(5, len(words_of(r["text"])))) for r in table(spark, SF, "benchmark").collect() if words_of(r["text"])]
    left = [d for d in left if not any(10 * len(s & shingled(d[1], n)) >= 8 * len(s) for s, n in items)]
    order = mixed(left)
    library, texts, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {i: t for i, t, _ in left}, 0, []
    for i in order:
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in corpus_pipeline.run(spark, SF).orderBy("start").collect()]
    assert got == want
