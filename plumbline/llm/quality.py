"""Operator 9, a quality classifier: naive Bayes support vectors.

Features are indicators of n-grams of words and of word shapes (one and two in a row, noting repeats), and of which
words among four in a row repeat the one before.  They are hashed into BUCKETS numbers, which bounds the model whatever
the texts hold; none is dropped, however rare.  Each is scaled by the log ratio of its smoothed counts in the two classes, rows are
brought to unit length, and a linear hinge-loss model is fitted by dual coordinate descent, whose cost keeps rare ones small.

A logistic curve makes margins probabilities.  It is fitted to margins of rows that the model measured with has not
seen: the training rows are parted into PARTS by a hash, and each part is measured by a model of the others.

The fit uses a bounded sample: at most SAMPLE labelled rows, those with the least hashes of doc_id, whole texts.
Scoring covers every whole text, in one pass without a shuffle.

Defined results: null text counts as empty and has the constant feature alone.  Rows of labels with null doc_id or
quality teach nothing; of repeated labels the least counts, of repeated documents the one with the least hash of text.
With no labels of both classes the score is the share of label 1 (0.5 with no labels).  Repeated rows are scored each;
extra columns are harmless; an empty table gives an empty table."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import empty_if_null, prepare
from .langid import fold

#: Bound of the fit, in labelled rows; features, a power of two; and parts of the rows for the logistic curve.
SAMPLE, BUCKETS, PARTS = 6000, 1 << 20, 3

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3

#: Smoothing of the class counts, cost of the hinge loss, passes of the descent.
SMOOTHING, COST, PASSES = 1.0, 1.0, 20

MEMO_ENTRIES = 300_000

_SHAPES = [(re.compile(p), s) for p, s in ((r"[^\W\d_a-zß-ÿ]{2,}", "U"), (r"[^\W\d_]+", "w"), (r"\d+", "9"))]


def shape(word: str) -> str:
    """A word with runs of letters as w (U where all are capitals) and digits as 9; other characters stay, once a run."""
    for pattern, sign in _SHAPES:
        word = pattern.sub(sign, word)
    return re.sub(r"(.)\1+", r"\1+", word)


#: A feature for each way in which three words in a row may repeat the one before.
RUNS = np.array([xxh64_intdigest(str(i), 3) for i in range(8)], np.uint64)

_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


class Features:
    """Texts to sorted distinct numbers of features, below BUCKETS; one per task, with a memo of words."""

    def __init__(self):
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, 2), np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int32)
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        for w in set(words).difference(memo):
            if len(memo) >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[len(memo)] = xxh64_intdigest(w.lower(), 1), xxh64_intdigest(shape(w), 2)
            memo[w] = len(memo)
        h = self.rows[np.fromiter(map(memo.__getitem__, words), np.int64, len(words))]
        word, form = h[:, 0], h[:, 1]
        repeat = (word[1:] == word[:-1]).astype(np.uint64)
        with np.errstate(over="ignore"):
            pairs = word[1:] * np.uint64(0x9E3779B97F4A7C15) + word[:-1]
            forms = form[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + form[:-1] + repeat * np.uint64(0x9E3779B97F4A7C15)
        runs = np.unique(repeat[2:] * np.uint64(4) + repeat[1:-1] * np.uint64(2) + repeat[:-2]) if len(words) > 3 else repeat[:0]
        return np.unique((np.concatenate([word, form, pairs, forms, RUNS[runs]]) >> _SHIFT).astype(np.int32))


class Model:
    """The ratios and weights of all features, the constant's weight, and the logistic curve (slope, offset)."""

    def __init__(self, ratios: np.ndarray, weights: np.ndarray, constant: float, slope: float = 1.0, offset: float = 0.0):
        self.squares, self.scaled = (ratios**2).astype(np.float32), (ratios * weights).astype(np.float32)
        self.constant, self.slope, self.offset = constant, slope, offset

    def margin(self, features: np.ndarray) -> float:
        size = np.sqrt(1.0 + float(self.squares[features].sum(dtype=np.float64)))
        return (self.constant + float(self.scaled[features].sum(dtype=np.float64))) / size

    def score(self, features: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(features) + self.offset, -700, 700))))


def descend(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """The linear model, its curve yet the identity."""
    good, bad = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    for at, y in zip(rows, labels):
        (good if y else bad)[at] += 1
    ratios = np.log(good / good.sum()) - np.log(bad / bad.sum())
    sizes = np.sqrt([1.0 + (ratios[at] ** 2).sum() for at in rows])
    sign = np.where(labels > 0, 1.0, -1.0)
    share = labels.mean()
    cost = COST * np.where(labels > 0, 1.0, max(1.0, share / (1 - share)) ** 0.5)
    w, constant, alpha, order = np.zeros(BUCKETS), 0.0, np.zeros(len(rows)), np.random.default_rng(0)
    for _ in range(PASSES):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at = rows[i]
            x = ratios[at] / sizes[i]
            gradient = sign[i] * (w[at] @ x + constant / sizes[i]) - 1.0
            new = min(max(alpha[i] - gradient, 0.0), cost[i])  # rows have unit length
            if step := (new - alpha[i]) * sign[i]:
                w[at] += step * x
                constant += step / sizes[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return Model(ratios, w, constant)


def train(rows: list[np.ndarray], labels: np.ndarray, parts: np.ndarray) -> Model:
    """The model of rows of features, labels 0 or 1, and the part of each row for the curve."""
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, float(np.log(p / (1 - p))))
    margins, measured = np.zeros(len(rows)), np.zeros(len(rows), bool)
    for k in range(PARTS):
        own = parts == k
        if own.any() and len(set(labels[~own].tolist())) == 2:
            others = descend([r for r, o in zip(rows, own) if not o], labels[~own])
            margins[own] = [others.margin(r) for r, o in zip(rows, own) if o]
            measured |= own
    model = descend(rows, labels)
    if len(set(labels[measured].tolist())) < 2:  # too few rows to hold any back
        margins, measured = np.array([model.margin(r) for r in rows]), np.ones(len(rows), bool)
    model.slope, model.offset = _logistic(margins[measured], labels[measured])
    return model


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest curve, with smoothed targets, by Newton's method."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, theta = np.column_stack([margins, np.ones_like(margins)]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        theta = theta - np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """The model learnt from labelled rows outside the held-out fold."""
    prepare(docs.sparkSession)
    known = labels.where(F.col(f"`{doc_id}`").isNotNull() & F.col(f"`{label}`").isNotNull() & (fold(doc_id, FOLDS) != HELD_OUT))
    known = known.groupBy(F.col(f"`{doc_id}`").cast("long").alias("id")).agg(F.min(F.col(f"`{label}`").cast("int")).alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # at most `sample` small rows, so it may be broadcast

    def run(batches):
        features = Features()
        for b in batches:
            found = [features(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], ["id", "label", "features"])

    chosen = docs.select(docs[f"`{doc_id}`"].cast("long").alias("id"), empty_if_null(text).alias("text")).join(F.broadcast(known), "id")
    # one text a document, before features are made
    chosen = chosen.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PARTS)).alias("part")
    table = chosen.mapInArrow(run, "id long, label int, features array<int>").select("id", "label", "features", part).orderBy("id").toArrow()
    rows = [np.asarray(x.values, np.int32) if x.values is not None else np.zeros(0, np.int32) for x in table["features"]] if table.num_rows else []
    return train(rows, np.array([1 if x else 0 for x in table["label"].to_pylist()], np.int64), np.array(table["part"].to_pylist(), np.int64))


def _scorer(sent):
    def run(batches):
        features, model = Features(), sent.value
        for b in batches:
            scores = [model.score(features(x)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], [b.schema.names[0], "score"])

    return run


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    prepare(docs.sparkSession)
    rows = docs.select(F.struct(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), (fold(doc_id, FOLDS) == HELD_OUT).alias("held_out")).alias("row"), empty_if_null(text).alias("text"))
    out = rows.mapInArrow(_scorer(sent), "row struct<doc_id: long, held_out: boolean>, score double")
    return out.select("row.doc_id", "row.held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that the model does not reject, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    prepare(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), empty_if_null(text).alias("text"))
    out = rows.mapInArrow(_scorer(sent), rows.select("row").schema.add("score", "double"))
    return out.where(F.col("score") >= THRESHOLD).select("row.*")
