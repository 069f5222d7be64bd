"""Operator 5, language identification by words with backoff to character n-grams.

A word known from training adds its log frequency in each language.  An unseen word adds the mean log frequency of its
known character n-grams of the greatest length that has any, from five characters down to one.

The model is fitted on a bounded sample: of each language the SAMPLE whole texts with the least 64-bit hashes of doc_id
and text.  All words and n-grams of the sample are kept, so the sample alone bounds the model, which is sent to every worker as
sorted 64-bit hashes and a row of logs each.  Prediction covers every whole text, in one pass without a shuffle.

Defined results: a text that is null or has no letter gives `und` and score 0, as do all texts where nothing could be
learnt.  Ties go to the alphabetically first language.  Texts with null lang teach nothing; a null doc_id counts as the
empty text in the fold's hash; rows that share doc_id, text and lang teach once.  Repeated rows are predicted each; extra
columns are harmless; an empty table gives an empty table."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import empty_if_null, prepare

#: Bound of the fit, in texts a language, and the longest n-gram.
SAMPLE, LONGEST = 1500, 5

FOLDS, HELD_OUT = 3, 1

#: Words that a worker remembers.
MEMO_ENTRIES = 300_000

LETTERS = re.compile(r"[^\W\d_]+")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo the folds."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("long").cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def grams(word: str, n: int) -> list[str]:
    marked = f"_{word}_" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def key(gram: str, n: int) -> int:
    """The 64-bit hash of a word (n = 0) or n-gram, by which the model knows it."""
    return xxh64_intdigest(gram, n)


def sampled(rows: DataFrame, sample: int) -> DataFrame:
    """Of rows (lang, h, text) those with the `sample` least h of each language.

    A hash limit that all but surely leaves twice that many keeps what is ranked small at any size; a language of which
    it left too few, which the counts tell, is ranked whole."""
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    limit = F.lit(None).cast("long")
    for name, n in counts.items():
        share = min(1.0, (2 * sample + 100) / n)
        limit = F.when(F.col("lang") == name, F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))).otherwise(limit)
    # equal rows are one before anything is ranked
    near = rows.where(F.col("h") <= limit).groupBy("lang", "h").agg(F.min("text").alias("text"))
    left = {r["lang"]: r["n"] for r in near.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    short = [name for name, n in counts.items() if left.get(name, 0) < min(sample, n) and n > 2 * sample + 100]
    if short:
        whole = rows.where(F.col("lang").isin(short)).groupBy("lang", "h").agg(F.min("text").alias("text"))
        near = near.where(~F.col("lang").isin(short)).unionByName(whole)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return near.withColumn("rank", rank).where(F.col("rank") <= sample).select("lang", "text")


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """The model learnt from the rows of the training folds."""
    prepare(docs.sparkSession)
    rows = docs.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull() & (fold(doc_id, FOLDS) != HELD_OUT))
    rows = rows.select(docs[f"`{lang}`"].cast("string").alias("lang"), F.xxhash64(docs[f"`{doc_id}`"], docs[f"`{text}`"]).alias("h"), docs[f"`{text}`"].cast("string").alias("text"))

    def count(batches):
        words: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words[name].update(LETTERS.findall(x.lower()))
        for name, found in words.items():
            total: dict[tuple[int, int], int] = Counter()
            for w, k in found.items():
                total[0, key(w, 0)] += k
                for n in range(1, LONGEST + 1):
                    for g in grams(w, n):
                        total[n, key(g, n)] += k
            items = list(total.items())
            for i in range(0, len(items), 50_000):
                part = items[i : i + 50_000]
                hashes = np.array([x[0][1] for x in part], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([x[0][0] for x in part], pa.int32()), pa.array(hashes), pa.array([x[1] for x in part], pa.int64())], ["lang", "n", "gram", "k"])

    summed = sampled(rows, sample).mapInArrow(count, "lang string, n int, gram long, k long").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k"))
    return Model.of(summed.select("lang", "n", "gram", "k").toArrow())


class Model:
    """Log frequencies: `keys` are sorted hashes of words and n-grams, `logs` has a row for each, a column a language."""

    def __init__(self, languages: list[str], keys: np.ndarray, logs: np.ndarray):
        self.languages, self.keys, self.logs = languages, keys, logs

    @classmethod
    def of(cls, table: pa.Table) -> Model:
        languages, column = np.unique(np.array(table["lang"].to_pylist(), object).astype(str), return_inverse=True)
        n, k = table["n"].to_numpy(), table["k"].to_numpy()
        keys, place = np.unique(table["gram"].to_numpy().view(np.uint64), return_inverse=True)
        counts, totals, length = np.zeros((len(keys), len(languages))), np.zeros((LONGEST + 1, len(languages))), np.zeros(len(keys), np.int64)
        np.add.at(counts, (place, column), k)
        np.add.at(totals, (n, column), k)
        length[place] = n
        return cls(languages.tolist(), keys, np.log((counts + 0.5) / (totals[length] + 1.0)).astype(np.float32))

    def find(self, hashes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and the rows of those that are."""
        wanted = np.array(hashes, np.uint64)
        if not len(self.keys):
            return np.zeros(len(wanted), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        known = self.keys[at] == wanted
        return known, at[known]


class Predictor:
    """Scores words with a memo; one per task."""

    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, max(1, len(model.languages))), np.float32)

    def _words(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word, all words of a length of n-grams at once."""
        logs, out = self.model.logs, np.zeros((len(words), self.rows.shape[1]), np.float32)
        known, at = self.model.find([key(w, 0) for w in words])
        out[known] = logs[at]
        todo = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            if not len(todo) or not len(self.model.keys):
                break
            each = [grams(words[i], n) for i in todo.tolist()]
            owner = np.repeat(np.arange(len(todo)), [len(x) for x in each])
            known, at = self.model.find([key(g, n) for x in each for g in x])
            found = np.bincount(owner[known], minlength=len(todo))
            sums = np.column_stack([np.bincount(owner[known], weights=logs[at, k], minlength=len(todo)) for k in range(logs.shape[1])])
            out[todo[found > 0]] = sums[found > 0] / found[found > 0, None]
            todo = todo[found == 0]
        return out

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = LETTERS.findall((text or "").lower())
        if not words or not self.model.languages:
            return "und", 0.0
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        if new := list(set(words).difference(memo)):
            while len(memo) + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[len(memo) : len(memo) + len(new)] = self._words(new)
            memo.update(zip(new, range(len(memo), len(memo) + len(new))))
        total = self.rows[np.fromiter(map(memo.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        return self.model.languages[best], 1.0 / math.fsum(math.exp(max(-700.0, x - total[best])) for x in total.tolist())


def predicted(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        predict = Predictor(sent.value)
        for b in batches:
            found = [predict(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), (fold(doc_id, FOLDS) == HELD_OUT).alias("held_out"), empty_if_null(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    return predicted(docs, fit(docs))
