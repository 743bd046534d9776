"""Language identification that asks for whole words first.

A language is known by the logarithms of the relative frequencies of its most
frequent words and character n-grams. A word of a text that any language knows is
scored by the frequencies in each; one that none knows by the mean of its longest
n-grams that any knows, five characters with the spaces around it and then
progressively shorter ones; what a language lacks costs it a fixed penalty. The
language of the lowest mean over all words of the whole text wins, by the method
of Jauhiainen, Linden and Jauhiainen (HeLI, 2016).

Learning counts the words of labelled rows that are not held out: a sample by
hash of each language's rows that is expected to hold LEARN bytes, or all of
them if they are fewer, for at most LANGUAGES languages, those with the most
bytes. Counting is distributed, and what the driver gets is bounded by ENTRIES.

A word is a run of letters and marks of the lower-cased text. A text that is null
or has no letter is `und`, score 0, as is every text if nothing could be learned.
A text in letters that no language knows goes to the language with the most
bytes, which also wins ties. The score is the winner's share among the languages'
likelihoods, whose logarithms are means times the root of the number of words:
neighbouring words tell much the same. Repeated rows and ids are judged row by
row; rows with a null language teach nothing; an empty table gives an empty
result. Only the named columns are read, so other columns may have any names.
Bytes that are not UTF-8 are replaced first.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sleuthframe.llm.ascii_words import windows
from sleuthframe.llm.common import pieces, shared_folder, table, written
from sleuthframe.llm.toxicity import held_out

#: Longest n-gram; -log10 of the relative frequency that a missing one is given.
LONGEST, PENALTY = 5, 7.0
#: Languages and bytes of text of each to learn from; words and n-grams of a model, and of each language and length at most.
LANGUAGES, LEARN, ENTRIES, MOST_WORDS, MOST_GRAMS = 1000, 2_000_000, 1_000_000, 20_000, 6_000
#: Words whose scores a worker remembers.
REMEMBER = 200_000
UNKNOWN = "und"


def tokens(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, the word of each token, the text of each token)."""
    lowered = pc.utf8_lower(pc.fill_null(column.cast(pa.string()), ""))
    lists = pc.split_pattern(pc.replace_substring_regex(lowered, r"[^\pL\pM]+", " "), " ")
    offsets, flat = lists.offsets.to_numpy(), lists.flatten()
    owner = np.repeat(np.arange(len(column)), np.diff(offsets))
    some = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(some).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), owner[some.to_numpy(zero_copy_only=False)]


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each piece of the labelled texts."""
    for batch in batches:
        lang = batch.column("lang").to_numpy(zero_copy_only=False).astype(np.int64)
        for at, many, part in windows(batch.column("text")):
            words, code, owner = tokens(part)
            pair, n = np.unique(lang[at + owner] * max(1, len(words)) + code, return_counts=True)
            yield pa.record_batch([pa.array((pair // max(1, len(words))).astype(np.int32)), pa.array(words, pa.string()).take(pa.array(pair % max(1, len(words)))), pa.array(n.astype(np.int64))], ["lang", "word", "n"])


class Model:
    """languages: by falling bytes learned from; words and grams: for each text
    the (language, what its frequency saves against the penalty) pairs."""

    def __init__(self, languages: list[str], words: dict[str, tuple[tuple[int, float], ...]], grams: dict[str, tuple[tuple[int, float], ...]]):
        self.languages, self.words, self.grams, self.known = languages, words, grams, {}

    def saved(self, word: str) -> tuple[tuple[int, float], ...]:
        """What each language saves with a word: by the word itself, else by the
        mean of its longest known n-grams."""
        found = self.words.get(word)
        if found is None:
            found, whole = (), f" {word} "
            for n in range(min(LONGEST, len(whole)), 0, -1):
                hits = [h for i in range(len(whole) - n + 1) if (h := self.grams.get(whole[i : i + n]))]
                if hits:
                    sums: dict[int, float] = {}
                    for h in hits:
                        for k, v in h:
                            sums[k] = sums.get(k, 0.0) + v
                    found = tuple((k, v / len(hits)) for k, v in sums.items())
                    break
        return found

    def means(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words, mean saving in each language) of each text."""
        many, wide = len(column), len(self.languages)
        count, sums = np.zeros(many, np.int64), np.zeros(many * wide)
        for at, n, part in windows(column):
            words, code, owner = tokens(part)
            if len(self.known) > REMEMBER:
                self.known.clear()
            known = self.known
            rows = [known[w] if w in known else known.setdefault(w, self.saved(w)) for w in words]
            size = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = [p for r in rows for p in r]
            lang, value = np.array([k for k, _ in flat], np.int64), np.array([v for _, v in flat])
            pair, times = np.unique(owner * max(1, len(words)) + code, return_counts=True)
            owner, code = pair // max(1, len(words)), pair % max(1, len(words))
            np.add.at(count, at + owner, times)
            begin = np.cumsum(size) - size
            i = np.arange(int(size[code].sum())) + np.repeat(begin[code] - np.cumsum(size[code]) + size[code], size[code])
            place = (at + np.repeat(owner, size[code])) * wide + lang[i]
            sums[at * wide : (at + n) * wide] += np.bincount(place - at * wide, value[i] * np.repeat(times, size[code]), n * wide)
        return count, sums.reshape(many, wide) / np.maximum(count, 1)[:, None]

    def judged(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        letters = pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)
        count, saved = self.means(column)
        told = letters & (count > 0) & bool(self.languages)
        if not self.languages:
            return [UNKNOWN] * len(column), np.zeros(len(column))
        best = saved.argmax(1)
        odds = np.exp((saved - saved.max(1, keepdims=True)) * math.log(10) * np.sqrt(count)[:, None])
        score = np.where(told, 1 / odds.sum(1), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, told, strict=True)], score


def _kept(counts: DataFrame, by: list[str], text: str, most: int) -> DataFrame:
    """The most frequent texts of each group, with -log10 of their relative
    frequency among all of it turned to what it saves against the penalty."""
    own = W.partitionBy(*by)
    share = F.col("n") / F.sum("n").over(own)
    place = F.row_number().over(own.orderBy(F.desc("n"), text))
    return counts.select("lang", F.col(text).alias("text"), (F.log10(share) + PENALTY).alias("saved"), place.alias("place")).filter((F.col("place") <= most) & (F.col("saved") > 0)).drop("place")


def _pairs(rows: DataFrame) -> dict[str, tuple[tuple[int, float], ...]]:
    found = rows.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("lang", "saved"))).alias("own"))
    return {r["text"]: tuple((k, v) for k, v in r["own"]) for r in found.toLocalIterator()}


def learn(docs: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: int = LANGUAGES, most_bytes: int = LEARN, entries: int = ENTRIES) -> Model:
    """A model of the rows of docs where `teaches` holds and the language is not null."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    told = docs.filter(teaches & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("name"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"))
    sizes = told.groupBy("name").agg(F.sum(F.octet_length("text")).alias("bytes")).orderBy(F.desc("bytes"), "name").limit(languages).collect()
    if not sizes:
        return Model([], {}, {})
    shares = spark.createDataFrame([(r["name"], i, min(1.0, most_bytes / max(1, r["bytes"]))) for i, r in enumerate(sizes)], "name string, lang int, share double")
    # at most `languages` rows
    sample = told.join(F.broadcast(shares), "name").filter(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("lang", "text")
    words = written(sample.mapInArrow(_word_counts, "lang int, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), f"{folder}/words")
    whole = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    lengths = F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("word") + 2))).alias("length")
    grams = words.select("lang", "n", whole.alias("whole"), lengths)
    grams = grams.select("lang", "n", "length", F.explode(F.transform(F.sequence(F.lit(1), F.length("whole") - F.col("length") + 1), lambda i: F.substring(F.col("whole"), i, F.col("length")))).alias("gram"))
    grams = grams.filter("gram <> ' '").groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))
    half = entries // 2 // len(sizes)
    return Model([r["name"] for r in sizes], _pairs(_kept(words, ["lang"], "word", max(1, min(MOST_WORDS, half)))), _pairs(_kept(grams, ["lang", "length"], "gram", max(1, min(MOST_GRAMS, half // LONGEST)))))


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows whose sums in all languages are held at once
        most = max(1, 4_000_000 // max(1, len(model.languages)))
        for batch in batches:
            for part in pieces(batch, "text", 4_000_000):
                for a in range(0, part.num_rows, most):
                    own = part.slice(a, most)
                    lang, score = model.judged(own.column("text"))
                    yield pa.record_batch([own.column("id"), pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, ~held_out(F.col("doc_id")))
    return identified(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
