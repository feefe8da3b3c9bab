"""Language identification by word-first backoff.

Known words carry a log frequency for each language. A word that isn't known falls back to its character n-grams: the longest
of which the model knows any, from LONGEST down to single characters; letters that it has never seen tell nothing. A text's
language is the one with the greatest sum over its words; the score is the posterior with the evidence of at most
EVIDENCE words' weight. A word is a run of letters and marks that begins with a letter; letters and marks are the Unicode
categories L and M, in training and prediction alike.

The model is fitted on a bounded sample: up to per_lang training documents of each language, by the hash of their id and text.
Tasks count the sample's words and n-grams, Spark adds them up, and the most frequent of both that fit into CELLS numbers, one for
each language, become the model; so what the driver gets and what is broadcast is bounded in bytes, whatever the number of
languages and the length of words. Predictions cover every row and every whole text.

Defined results: null text, and text without a letter, give `und` with score 0; a null id goes to the remainder 0; repeated
rows get equal results; ties go to the language first in code point order; without training rows everything is `und`; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bucket_of, saved, small_batches

#: Documents of each language that the model is fitted on; least count of a known word or n-gram; longest n-gram.
PER_LANG, MIN_COUNT, LONGEST, EVIDENCE = 1500, 2, 5, 20
#: Numbers that the model holds, half of them for words and half for n-grams; characters of its longest word.
CELLS, WORD_LENGTH = 8_000_000, 40
#: Languages up to which their counts are broadcast.
LANGUAGES = 10_000
#: Words outside the model whose scores a task keeps, and different words and n-grams that a task counts before it sends them.
KEPT, HELD = 300_000, 500_000
#: Joins language and gram in one name of a count.
_BETWEEN = "\x00"


@cache
def words_of() -> re.Pattern:
    """Words: a letter, then letters and marks, by their categories."""
    ranges: dict[str, list[list[int]]] = {"L": [], "M": []}
    for code in range(sys.maxunicode + 1):
        found = ranges.get(unicodedata.category(chr(code))[0])
        if found is not None:
            if found and found[-1][1] == code - 1:
                found[-1][1] = code
            else:
                found.append([code, code])
    letters, marks = ("".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in ranges[k]) for k in "LM")
    return re.compile(f"[{letters}][{letters}{marks}]*")


def grams_of(word: str) -> list[str]:
    """The n-grams of a word with its borders, without the borders themselves."""
    padded = f"^{word}$"
    return [g for k in range(1, LONGEST + 1) for i in range(len(padded) - k + 1) if (g := padded[i : i + k]) not in "^$"]


class Model:
    def __init__(self, langs: list[str], words: dict[str, int], word_rows: np.ndarray, grams: dict[str, int], gram_rows: np.ndarray):
        self.langs, self.words, self.grams, self.gram_rows = langs, words, grams, gram_rows
        self.rows = np.zeros((len(words) + KEPT + 1, len(langs)), dtype=np.float32)
        self.rows[: len(words)] = word_rows
        self.fixed, self.used, self.extra = len(words), len(words), {}

    def backoff(self, word: str) -> np.ndarray:
        padded, grams = f"^{word}$", self.grams
        for k in range(LONGEST, 0, -1):
            hits = [i for a in range(len(padded) - k + 1) if (i := grams.get(padded[a : a + k])) is not None]
            if hits:
                return self.gram_rows[hits].mean(axis=0)
        return np.zeros(len(self.langs), dtype=np.float32)

    def row(self, word: str) -> int:
        """The row of a word outside the model."""
        if (at := self.extra.get(word)) is None:
            at = self.extra[word] = self.used
            self.rows[at] = self.backoff(word)
            self.used += 1
        return at

    def totals(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(self.langs))
        for a in range(0, len(words), KEPT // 2):  # a part's new words always fit
            if self.used + KEPT // 2 > self.fixed + KEPT:
                self.extra, self.used = {}, self.fixed
            part = words[a : a + KEPT // 2]
            known = self.words
            at = [i if (i := known.get(w)) is not None else self.row(w) for w in part]
            out += self.rows[at].sum(axis=0, dtype=np.float64)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of().findall(text.lower()) if text else []
        if not words or not self.langs:
            return "und", 0.0
        sums = self.totals(words)
        p = np.exp((sums - sums.max()) * min(1.0, EVIDENCE / len(words)))
        best = int(np.argmax(sums))
        return self.langs[best], float(p[best] / p.sum())


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (language, text) to counts (language, size of the n-gram or 0 for words, gram, n)."""
    words: Counter[str] = Counter()

    def counted() -> Iterator[pa.RecordBatch]:
        grams: Counter[str] = Counter()
        for name, n in words.items():
            lang, _, w = name.partition(_BETWEEN)
            for g in grams_of(w):
                grams[lang + _BETWEEN + g] += n
        for found, size in ((words, False), (grams, True)):
            items = list(found.items())
            for a in range(0, len(items), 50_000):
                names, n = zip(*items[a : a + 50_000], strict=True)
                langs, _, texts = zip(*(x.partition(_BETWEEN) for x in names), strict=True)
                yield pa.record_batch([pa.array(langs), pa.array([len(t) if size else 0 for t in texts], pa.int32()), pa.array(texts), pa.array(n, pa.int64())], names=["l", "k", "g", "n"])

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words.update([lang + _BETWEEN + w for w in words_of().findall(text.lower())])
            if len(words) > HELD:
                yield from counted()
                words.clear()
    yield from counted()


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = PER_LANG) -> DataFrame:
    """Language and text of rows whose remainder isn't 2, per_lang of each language at most (ties of the hash by text)."""
    train = docs.filter((bucket_of(id_col, 4) != 2) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    train = train.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    # a language's rows are thinned by their hash before they are ranked: twice as many as wanted pass, so one task gets few
    many = saved(train.groupBy("l").agg(F.approx_count_distinct("h").alias("kinds")).withColumnRenamed("l", "k"))
    many = F.broadcast(many) if many.count() <= LANGUAGES else many  # else Spark deals both sides, and splits skewed languages
    share = F.lit(2.0 * per_lang + 200) / F.col("kinds")
    train = train.join(many, F.col("l") == F.col("k")).filter((F.col("h") / 2.0**64 + 0.5) < share)
    # repeated rows (one id, one text) tell nothing new
    few = train.groupBy("l", "h").agg(F.min("t").alias("t"))
    few = few.withColumn("r", F.row_number().over(W.partitionBy("l").orderBy("h", "t"))).filter(F.col("r") <= per_lang)
    return few.select("l", "t")


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = PER_LANG, cells: int = CELLS) -> Model:
    """Learn from the sample."""
    few = sample(docs, id_col, text_col, lang_col, per_lang)
    counts = saved(few.mapInArrow(count_grams, "l string, k int, g string, n long").groupBy("l", "k", "g").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("l", "k").agg(F.sum("n").alias("n")).collect()  # LONGEST + 1 for each language
    langs = sorted({r["l"] for r in totals})
    total = np.zeros((LONGEST + 1, len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    for r in totals:
        total[r["k"], place[r["l"]]] = r["n"]
    rows = cells // 2 // max(1, len(langs))
    kind = F.col("k") == 0
    sums = counts.filter(~kind | (F.length("g") <= WORD_LENGTH)).groupBy("k", "g").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("l", "n"))).alias("by")).filter(F.col("all") >= MIN_COUNT)

    def table(chosen: DataFrame) -> tuple[dict[str, int], np.ndarray]:
        """The most frequent and their log frequencies, centred, as only differences between languages matter."""
        found = chosen.orderBy(F.desc("all"), "g").limit(rows).select("k", "g", F.map_entries("by").alias("by")).toArrow()
        kinds, lists = found.column(0).to_numpy(), found.column(2).combine_chunks()
        n = np.zeros((len(kinds), len(langs)), dtype=np.float32)
        flat = lists.flatten()
        at = np.repeat(np.arange(len(kinds)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) if len(kinds) else np.zeros(0, np.int64)
        n[at, [place[x] for x in flat.field(0).to_pylist()]] = flat.field(1).to_numpy(zero_copy_only=False)
        logs = np.log((n + 0.1) / (total[kinds] + 1.0)) if len(kinds) else n
        return {g: i for i, g in enumerate(found.column(1).to_pylist())}, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32) if len(kinds) else n

    if not langs:
        return Model([], {}, np.zeros((0, 0), np.float32), {}, np.zeros((0, 0), np.float32))
    return Model(langs, *table(sums.filter(kind)), *table(sums.filter(~kind)))


_models: dict[str, Model] = {}


def detect_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    spark: SparkSession = docs.sparkSession
    model = fit(docs, id_col, text_col, lang_col, per_lang)
    parts = spark.sparkContext.broadcast((model.langs, model.words, model.rows[: model.fixed], model.grams, model.gram_rows))
    key = f"{spark.sparkContext.applicationId}-{parts._jbroadcast.id()}"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _models:
            _models.clear()
            _models[key] = Model(*parts.value)
        m = _models[key]
        for b in batches:
            found = [m.predict(t) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), (bucket_of(id_col, 4) == 2).alias("held_out"), F.col(text_col).alias("t"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
