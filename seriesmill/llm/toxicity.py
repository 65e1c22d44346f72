"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is one of 2^18 buckets that hold the hashed n-grams (3 to 6 characters of a lower-cased word between its edges, and the whole word) of at least one word of the text; how often does not matter, so long texts are judged by what they hold. A feature's value is its log-count ratio r: the log of its share among toxic training texts over its share among the others, each count raised by one. On these values a logistic regression with an L2 penalty is fitted by gradient descent with momentum; its constant is fitted too.

Labels are learnt only from rows whose crc32 of the id, as text, leaves a remainder other than 0 modulo 5. The classifier is fitted on at most `SAMPLE` texts of each label, those with the smallest hashes of the id; of several rows of one id the text with the smallest hash is learnt from. That is the documented bound. Texts are counted on the executors, and a bucket is left out of the fit if fewer than `LEAST_TEXTS` of the sample's texts hold it or its ratio lies within `LEAST_RATIO` of zero, as those say little; only the rest of the sample's features meet in the driver. Every text is scored whole.

Null texts count as empty; a text without words gets the score of the constant alone. Labels that are null, or whose id is null or has no text, are not learnt from; of several labels for one id the largest counts. Without any label of either kind, or without training rows, all scores are 0. Repeated rows get the same scores. An empty table gives an empty result. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, materialize

BUCKETS = 1 << 18
SAMPLE = 2500
SHORTEST, LONGEST = 3, 6
ROUNDS, PENALTY, LEAST_TEXTS, LEAST_RATIO, WEIGHT = 200, 1e-4, 2, 1.2, 0.5
WORD = re.compile(r"[^\W\d_]+")


def _word_features(word: str) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    edged = f"<{word}>"
    grams = {edged[k : k + n] for n in range(SHORTEST, LONGEST + 1) for k in range(len(edged) - n + 1)} | {edged}
    return np.array([xxh3_64_intdigest(g) & BUCKETS - 1 for g in grams], np.int32)


class Features:
    """Buckets of texts, with those of words remembered."""

    def __init__(self):
        self.words = Memo(_word_features, 120_000)
        self.seen = np.zeros(BUCKETS, bool)

    def of(self, text: str) -> np.ndarray:
        words = {*WORD.findall(text.lower())}
        if not words:
            return np.zeros(0, np.int32)
        found = np.concatenate([self.words[w] for w in words])
        if len(found) < 4096:
            return np.unique(found)
        self.seen[found] = True
        found = np.flatnonzero(self.seen).astype(np.int32)
        self.seen[found] = False
        return found


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    def __init__(self, weights: np.ndarray | None = None, constant: float = -np.inf):
        self.weights, self.constant = weights, constant


class Scorer:
    """Scores of whole texts. Only buckets with a weight are kept of each word, so a text's set of them is small."""

    def __init__(self, model: Model):
        self.model = model
        self.words = Memo(self._weighted, 400_000)

    def _weighted(self, word: str) -> tuple[int, ...]:
        found = _word_features(word)
        return tuple(found[self.model.weights[found] != 0].tolist())

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.model.weights is None:
            return np.zeros(len(texts))
        sums = np.zeros(len(texts))
        for k, text in enumerate(texts):
            buckets = set().union(*map(self.words.__getitem__, {*WORD.findall(text.lower())}))
            sums[k] = math.fsum(self.model.weights[list(buckets)]) if buckets else 0.0
        return 1 / (1 + np.exp(-np.clip(sums + self.model.constant, -500, 500)))


def _train_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (toxic, features) of (toxic, text) for texts with words."""
    features = Features()
    for batch in batches:
        found = [features.of(x or "").tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x or None for x in found], pa.binary())], ["toxic", "features"])


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (toxic, bucket, n): how many texts hold each bucket; bucket -1 counts all."""
    counts = np.zeros((2, BUCKETS + 1), np.int64)
    for batch in batches:
        for toxic, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts[toxic, np.frombuffer(x.as_buffer(), np.int32)] += 1
            counts[toxic, BUCKETS] += 1
    toxic, bucket = np.nonzero(counts)
    columns = [toxic.astype(np.int32), np.where(bucket == BUCKETS, -1, bucket).astype(np.int32), counts[toxic, bucket]]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["toxic", "bucket", "n"])


def _only(used: np.ndarray):
    """The rows with the used buckets only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[used[x]].tobytes() for x in found], pa.binary())], ["toxic", "features"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """Fit on a bounded sample of labelled rows that are not held out."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("id", F.lit("sample"))
    sample = known.where("toxic = 1").orderBy(order, "id").limit(SAMPLE).union(known.where("toxic = 0").orderBy(order, "id").limit(SAMPLE))
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    # The sample has at most 2 * SAMPLE rows of two numbers.
    one = texts.join(F.broadcast(sample), "id").groupBy("id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    kept = materialize(one.select("toxic", "text").mapInArrow(_train_features, "toxic int, features binary").where("features is not null"), "toxicity-sample")
    counted = kept.mapInArrow(_count_features, "toxic int, bucket int, n bigint").groupBy("toxic", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, BUCKETS + 1))
    counts[counted.column(0).to_numpy(), counted.column(1).to_numpy()] = counted.column(2).to_numpy()
    ratio = log_ratios(counts[:, :-1], counts[:, -1])
    rows = kept.mapInArrow(_only(ratio != 0), "toxic int, features binary").toArrow()
    toxic = rows.column(0).to_numpy().astype(np.float64)
    found = [np.frombuffer(x.as_buffer(), np.int32) for x in rows.column(1)]
    order = sorted(range(len(found)), key=lambda k: (toxic[k], len(found[k]), zlib.crc32(found[k])))
    return fit_ratios(toxic[order], [found[k] for k in order], ratio)


def log_ratios(counts: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The log-count ratio of each bucket, 0 for those that are left out: counts of other and of toxic texts with each bucket, and of all."""
    shares = (counts + 1) / (texts[:, None] + 2)
    ratio = np.log(shares[1]) - np.log(shares[0])
    # A feature of one text says nothing about others, and one as common in both little.
    return ratio * ((counts.sum(axis=0) >= LEAST_TEXTS) & (np.abs(ratio) >= LEAST_RATIO))


def fit_features(toxic: np.ndarray, found: list[np.ndarray]) -> Model:
    if not len(toxic) or toxic.min() == toxic.max():
        return Model()
    keep = [k for k in range(len(found)) if len(found[k])]
    toxic, found = toxic[keep], [found[k] for k in keep]
    if not len(toxic) or toxic.min() == toxic.max():
        return Model()
    counts = np.zeros((2, BUCKETS))
    for x, y in zip(found, toxic, strict=True):
        counts[int(y), x] += 1
    ratio = log_ratios(counts, np.array([(1 - toxic).sum(), toxic.sum()]))
    return fit_ratios(toxic, [x[ratio[x] != 0] for x in found], ratio)


def fit_ratios(toxic: np.ndarray, found: list[np.ndarray], ratio: np.ndarray) -> Model:
    """The logistic regression on texts' buckets, those with a ratio only."""
    if not len(toxic) or toxic.min() == toxic.max():
        return Model()
    used = np.flatnonzero(ratio)
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    flat = np.concatenate(found)
    rows = np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found])
    columns, values = place[flat], ratio[flat]
    # Rare labels count as much as common ones in the fit, the constant takes the share of either.
    weight = np.where(toxic == 1, WEIGHT / toxic.sum(), (1 - WEIGHT) / (1 - toxic).sum())
    w, constant, speed, constant_speed = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    size = np.bincount(rows, values * values, len(found)).mean()
    rate = 4.0 / max(size, 1e-9)
    for _ in range(ROUNDS):
        scores = np.bincount(rows, values * w[columns], len(found)) + constant
        error = (1 / (1 + np.exp(-np.clip(scores, -500, 500))) - toxic) * weight
        speed = 0.9 * speed - rate * (np.bincount(columns, values * error[rows], len(used)) + PENALTY * w)
        constant_speed = 0.9 * constant_speed - 0.5 * error.sum()
        w, constant = w + speed, constant + constant_speed
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w * ratio[used]
    return Model(weights, float(constant))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = scorer.scores([x or "" for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], ["id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, held_out, score, predicted)."""
    source = docs.select(F.col(id_column).alias("id"), held_out(F.col(id_column)).alias("held_out"), F.col(text_column).alias("text"))
    ids = docs.schema[id_column].dataType.simpleString()
    scored = source.mapInArrow(_score(model), f"id {ids}, held_out boolean, score double")
    return scored.select("id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The documents, with all their columns, whose score is below one half."""
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores([x or "" for x in batch.column(at).to_pylist()]) < 0.5))

    return docs.mapInArrow(run, docs.schema)
