"""Toxicity of texts by a lexicon that tolerates misspellings.

The lexicon's terms, whole words or word beginnings, form a trie. A word of a
text becomes a Levenshtein automaton, and what automaton and trie accept
together are the terms it may be a misspelling of. The words around a hit tell
quotation (quote marks, reporting verbs) from abuse (address in the second
person). A logistic function of the weighted hits is the score.

Terms, weights and function are learned from labelled rows: from at most
MAX_LABELLED of them, those of least hash of their ids. A text gets the score
of its own words alone. Null, empty and wordless texts have no hits and get the
score of a text without hits. Without labelled rows of both kinds all scores
are 0. Repeated rows are scored row by row, a null id is not held out; an empty
table gives an empty result; other columns may have any names. One letter more,
less or other is one edit and may be; swapped letters are two and may not.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuthframe.llm.common import Remembered, kept, pieces, shared_folder, table, written
from sleuthframe.llm.shingles import text_keys

MAX_LABELLED = 6000
#: A term is in at least so many toxic sample texts; so many terms explain each of them at most.
LEAST_TEXTS, COVER = 3, 8
SHORTEST_PREFIX, LONGEST_PREFIX = 4, 6
#: Shorter terms are only matched as they are.
SHORTEST_FUZZY = 5
QUOTED, ADDRESSED = 0.3, 1.2
WINDOW = 60
REPORTING = re.compile(r"\b(?:said|says|quote[ds]?|called|wrote|writes|reported|term|word|sagte|schrieb|zitat|dijo|escribió|palabra|disait|écrit|mot)\b")
SECOND_PERSON = re.compile(r"\b(?:you|your|youre|du|dich|ihr|tú|eres|usted|tu|toi|vous)\b")
QUOTES = re.compile(r"[\"“”„«»‘’]")


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@functools.cache
def _stands_in() -> np.ndarray:
    return np.fromiter((chr(c) in "0123456789@$*" for c in range(128)), bool, 128)


def letter_runs(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined in lower case, and their code points; begin and end of each
    run of letters; and the index of each text's first run, one more at
    the end."""
    lowered = [t.lower() for t in texts]
    joined = "\n".join(lowered)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _letters()[codes]
    # a digit or symbol between two letters stands for a letter: id1ot, st*pid
    between = np.flatnonzero(_stands_in()[np.minimum(codes, 127)][1:-1] & inside[:-2] & inside[2:]) + 1 if len(codes) > 2 else np.zeros(0, np.int64)
    inside[between] = True
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
    first = np.searchsorted(begin, bounds)
    return joined, codes, begin, end, first


class Automaton:
    """Accepts what is within some edits of a word. A state is the row of edit
    distances to the word's beginnings."""

    def __init__(self, word: str, edits: int):
        self.word, self.edits = word, edits

    def start(self) -> tuple[int, ...]:
        return tuple(range(len(self.word) + 1))

    def step(self, state: tuple[int, ...], c: str) -> tuple[int, ...]:
        row = [state[0] + 1]
        for k, w in enumerate(self.word):
            row.append(min(row[k] + 1, state[k + 1] + 1, state[k] + (w != c)))
        return tuple(row)

    def alive(self, state: tuple[int, ...]) -> bool:
        return min(state) <= self.edits

    def accepts(self, state: tuple[int, ...], *, beginning: bool) -> bool:
        """beginning: the term may be the beginning of the word only."""
        return (min(state) if beginning else state[-1]) <= self.edits


class Lexicon:
    """terms: {(text, is a beginning): weight}."""

    def __init__(self, terms: dict[tuple[str, bool], float]):
        self.trie: dict = {}
        self.terms = terms
        self.heads, self.middles = set(), set()
        for (text, beginning), weight in terms.items():
            node = self.trie
            for c in text:
                node = node.setdefault(c, {})
            node.setdefault("", []).append((len(text), beginning, weight))
            if len(text) >= SHORTEST_FUZZY:
                # one edit leaves the first three letters or the next ones whole
                self.heads.add(text[:3])
                self.middles.add(text[3:6])
        self.sizes = sorted({len(m) for m in self.middles})
        self.starts = {t[0][: SHORTEST_PREFIX - 1] for t in terms}

    def exact(self, word: str) -> float:
        node, best = self.trie, 0.0
        for k, c in enumerate(word):
            node = node.get(c)
            if node is None:
                return best
            for _, beginning, weight in node.get("", ()):
                if beginning or k == len(word) - 1:
                    best = max(best, weight)
        return best

    def fuzzy(self, word: str) -> float:
        """The weight of the best term within one edit."""
        if len(word) < SHORTEST_FUZZY - 1 or not (word[:3] in self.heads or any(word[k : k + n] in self.middles for k in (2, 3, 4) for n in self.sizes)):
            return 0.0
        automaton, best = Automaton(word, 1), 0.0
        todo = [(self.trie, automaton.start())]
        while todo:
            node, state = todo.pop()
            for n, beginning, weight in node.get("", ()):
                if n >= SHORTEST_FUZZY and weight > best and automaton.accepts(state, beginning=beginning):
                    best = weight
            for c, below in node.items():
                if c:
                    after = automaton.step(state, c)
                    if automaton.alive(after):
                        todo.append((below, after))
        return best


@dataclass
class Model:
    """terms of the lexicon; bias and factors of the sums of exact and of
    misspelt hits. Without terms there are no scores but `bias`'s."""

    terms: dict[tuple[str, bool], float]
    bias: float
    factors: tuple[float, float]


class Scorer:
    def __init__(self, terms: dict[tuple[str, bool], float]):
        self.lexicon, self.known = Lexicon(terms), Remembered(np.zeros((0, 2)))

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """Logarithms of one plus the weighted sums of exact and misspelt hits."""
        joined, codes, begin, end, first = letter_runs([t or "" for t in texts])
        out = np.zeros((len(texts), 2))
        weight = self.known.values_of(*text_keys(codes, begin, end - begin), codes, begin, end, lambda some: np.array([self.weights(joined[begin[i] : end[i]]) for i in some.tolist()]))
        hits = np.flatnonzero(weight.any(1))
        owner = np.searchsorted(first, hits, "right") - 1
        for i, t in zip(hits.tolist(), owner.tolist(), strict=True):
            low, high = begin[first[t]], end[first[t + 1] - 1]
            out[t] += weight[i] * self.context(joined[max(low, begin[i] - WINDOW) : begin[i]], joined[end[i] : min(high, end[i] + WINDOW)])
        return np.log1p(out)

    def weights(self, word: str) -> tuple[float, float]:
        """Of the word as a term, and as a misspelt one if it is none."""
        exact = self.lexicon.exact(word)
        return (exact, 0.0) if exact else (0.0, self.lexicon.fuzzy(word))

    @staticmethod
    def context(before: str, after: str) -> float:
        """Less than 1 for quotation, more for address."""
        factor = 1.0
        if QUOTES.search(before[-WINDOW // 2 :]) and QUOTES.search(after[: WINDOW // 2]) or REPORTING.search(before):
            factor *= QUOTED
        if SECOND_PERSON.search(before + " " + after):
            factor *= ADDRESSED
        return factor


def _terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, beginning, toxic texts, other texts), summed over each piece."""
    for batch in batches:
        for part in pieces(batch, "text"):
            counts: Counter = Counter()
            joined, _, begin, end, first = letter_runs([t or "" for t in part.column("text").to_pylist()])
            for t, toxic in enumerate(part.column("toxic").to_pylist()):
                words = {joined[begin[i] : end[i]] for i in range(first[t], first[t + 1])}
                found = {(w, False) for w in words} | {(w[:n], True) for w in words for n in range(SHORTEST_PREFIX, LONGEST_PREFIX + 1) if len(w) > n}
                counts.update((w, b, toxic) for w, b in found)
            term, beginning, toxic = zip(*counts, strict=True) if counts else ((), (), ())
            yield pa.record_batch([pa.array(term, pa.string()), pa.array(beginning, pa.bool_()), pa.array(toxic, pa.int32()), pa.array(list(counts.values()), pa.int64())], ["term", "beginning", "toxic", "n"])


def _members(names: set[tuple[str, bool]]):
    """Which of these terms each toxic sample text holds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            joined, _, begin, end, first = letter_runs([t or "" for t in batch.column("text").to_pylist()])
            for t in range(batch.num_rows):
                words = {joined[begin[i] : end[i]] for i in range(first[t], first[t + 1])}
                found = {(w, False) for w in words} | {(w[:n], True) for w in words for n in range(SHORTEST_PREFIX, LONGEST_PREFIX + 1) if len(w) > n}
                out.append([f"{w} {int(b)}" for w, b in sorted(found & names)])
            yield pa.record_batch([pa.array(out, pa.list_(pa.string()))], ["terms"])

    return run


def choose_terms(texts: list[set[tuple[str, bool]]], odds: dict[tuple[str, bool], float]) -> dict[tuple[str, bool], float]:
    """Terms that explain the toxic texts, each up to COVER times: again and
    again the one that counts in most texts; of equals the longer, whole words
    before beginnings, so that chance words of copied texts stay out."""
    need = [COVER] * len(texts)
    holders: dict[tuple[str, bool], list[int]] = {}
    for k, found in enumerate(texts):
        for t in found:
            holders.setdefault(t, []).append(k)
    chosen: dict[tuple[str, bool], float] = {}
    covered = [False] * len(texts)
    least = max(LEAST_TEXTS, len(texts) // 200)
    while holders:
        gain = {t: sum(1 for k in ks if need[k] > 0) for t, ks in holders.items()}
        best = max(gain, key=lambda t: (gain[t], len(t[0]), not t[1], t[0]))
        if gain[best] < least:
            break
        new = sum(not covered[k] for k in holders[best])
        share = gain[best] / len(texts)
        if new or share >= 0.05:
            chosen[best] = odds[best]
            for k in holders[best]:
                need[k] -= 1
                covered[k] = True
        del holders[best]
        for t in [t for t in holders if t[0].startswith(best[0]) or best[1] and t[1] and best[0].startswith(t[0])]:
            del holders[t]
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[float, float]]:
    """Bias and non-negative factors, by projected Newton steps with a little
    shrinkage; both kinds weigh the same."""
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    shrink = np.diag([1e-6] + [1e-4] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (weight * (p - y)) + shrink @ w
        bend = (a * (weight * p * (1 - p))[:, None]).T @ a + shrink + 1e-9 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(bend, slope), -2, 2)
        w[1:] = np.maximum(w[1:], 0)
    return float(w[0]), (float(w[1]), float(w[2]))


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from rows that are not held out. What the driver gets is bounded by
    the sample's size."""
    spark = docs.sparkSession
    told = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    told = told.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    told = written(told)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(told), "id").select("text", "toxic")
    sample = written(sample.repartition(16, F.xxhash64("text")), f"{shared_folder(spark)}/sample")
    total = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return Model({}, -math.inf, (0.0, 0.0))
    counts = sample.mapInArrow(_terms, "term string, beginning boolean, toxic int, n bigint").groupBy("term", "beginning").agg(F.sum(F.col("n") * F.col("toxic")).alias("a"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("c"))
    odds = F.log((F.col("a") + 0.5) / (total[1] + 1)) - F.log((F.col("c") + 0.5) / (total[0] + 1))
    telling = counts.filter(F.col("a") >= LEAST_TEXTS).withColumn("odds", odds).filter((F.col("odds") > math.log(20)) & (F.col("c") * 50 <= F.col("a")))
    found = {(r["term"], r["beginning"]): r["odds"] for r in telling.collect()}
    texts = [{(t[:-2], t[-1] == "1") for t in r["terms"]} for r in sample.filter("toxic = 1").select("text").mapInArrow(_members(set(found)), "terms array<string>").collect()]
    terms = choose_terms(texts, found)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms)
        for batch in batches:
            for part in pieces(batch, "text"):
                x = scorer.sums(part.column("text").to_pylist())
                yield pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1]), part.column("toxic")], ["exact", "fuzzy", "toxic"])

    rows = np.array(sample.mapInArrow(sums, "exact double, fuzzy double, toxic int").collect(), float).reshape(-1, 3)
    return Model(terms, *fit_logistic(rows[:, :2], rows[:, 2]))


def _scorer(terms: dict[tuple[str, bool], float]) -> Scorer:
    return kept(("toxicity", tuple(sorted(terms.items()))), lambda: Scorer(terms))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model.terms)
        for batch in batches:
            for part in pieces(batch, "text"):
                x = scorer.sums(part.column("text").to_pylist()) @ np.array(model.factors) + model.bias
                yield pa.record_batch([part.column("id"), pa.array(1 / (1 + np.exp(-np.clip(x, -700, 700))) if model.terms else np.zeros(len(x)))], ["id", "score"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without those whose text scores 0.5 or more; columns as they are."""
    scorer_terms, factors, bias = model.terms, model.factors, model.bias

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(scorer_terms)
        for batch in batches:
            for part in pieces(batch, text_col):
                x = scorer.sums(part.column(text_col).to_pylist()) @ np.array(factors) + bias
                yield part.filter(pa.array(x < 0))

    return docs.mapInArrow(run, docs.schema) if model.terms else docs


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
