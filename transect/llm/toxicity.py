"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic texts are the positives; other texts of the corpus, whatever their label, are the unlabelled ones.
With the class prior p, the risk of a linear classifier is

    p R+(toxic as toxic)  +  max(0, R-(unlabelled as clean) - p R-(toxic as clean)),

and where the second term turns negative, its gradient is followed upwards instead, so that the classifier doesn't
overfit the unlabelled texts. Features are hashed words and beginnings of words (4 to 6 bytes), by
presence, and for beginnings also whether they occur at least twice: one may be chance in a long text. Words are lower-cased
(A-Z) and end at punctuation (ASCII) as they do at white space.

Bounded by parameters: the positives and unlabelled texts to learn from (``MAX_POSITIVE``, ``MAX_UNLABELLED``, chosen
by a hash of doc_id) and the features with a weight (``MAX_FEATURES``). Scoring reads every whole text.

These features and the least lift and z-score of a feature were chosen by the mean AUC, then the share found, over three folds
of rows that may be learnt from, without the held-out ones.

A document that several labels call toxic counts once, and is toxic if one of them says so; rows of one doc_id are samples of
their own; empty and null texts have no feature and get the bias alone; equal scores need no order. Where more rows than
twice the bounds come together (many rows of one id), those of the smallest hashes stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mix, prepare, text_slices, with_few, word_spans

MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 3_000, 9_000, 1_024
LEAST_LIFT, LEAST_Z = 5.0, 5.0
THRESHOLD = 0.3
_PREFIXES, _TIMES = (4, 5, 6), (2,)
_LOG_SPACE = 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32  # punctuation


def _features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) for every word of a slice and its beginnings, with repeats, and for beginnings that a row has several times."""
    raw = _LOWER[raw]
    starts, ends, words = word_spans(raw, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(words))
    rows, found = [], []
    for p, hashes in zip((0, *_PREFIXES), hash_words(raw, starts, ends, _PREFIXES), strict=True):
        some = np.flatnonzero(hashes) if p else slice(None)
        rows.append(row[some])
        found.append((hashes[some] >> np.uint64(64 - _LOG_SPACE)).astype(np.int32))
        if not p:
            continue
        both = np.sort(rows[-1].astype(np.int64) << _LOG_SPACE | found[-1])
        for k in _TIMES:
            again = np.unique(both[k - 1 :][both[k - 1 :] == both[: len(both) - k + 1]])
            rows.append(again >> _LOG_SPACE)
            found.append((mix((again & ((1 << _LOG_SPACE) - 1)).astype(np.uint64) + np.uint64(k << 32)) >> np.uint64(64 - _LOG_SPACE)).astype(np.int32))
    return np.concatenate(rows), np.concatenate(found)


def _feature_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, raw, at in text_slices(batch.column(1)):
            row, found = _features(raw, at)
            both = np.unique(row.astype(np.int64) << _LOG_SPACE | found)
            cuts = np.searchsorted(both >> _LOG_SPACE, np.arange(last - first + 1))
            kept = (both & ((1 << _LOG_SPACE) - 1)).astype(np.int32)
            blobs = [kept[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(blobs, pa.binary())], ["kind", "features"])


@dataclass
class Model:
    column: np.ndarray  # feature -> weight's number, or -1
    weights: np.ndarray
    bias: float

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        row, found = _features(raw, at)
        own = self.column[found]
        hit = np.flatnonzero(own >= 0)
        both = np.unique(row[hit].astype(np.int64) * len(self.weights) + own[hit])
        total = np.bincount(both // len(self.weights), self.weights[both % len(self.weights)], len(at) - 1)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 300, rate: float = 0.02, decay: float = 5e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier for 0/1 feature matrices, by Adam on all rows."""
    x, u = positive.astype(np.float32), unlabelled.astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zx, zu = np.clip(x @ w[:-1] + w[-1], -30, 30), np.clip(u @ w[:-1] + w[-1], -30, 30)
        sx, su = 1 / (1 + np.exp(-zx)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zx).mean()
        minus_x, minus_u, plus_x = -prior * sx / len(x), su / len(u), -prior * (1 - sx) / len(x)
        gx, gu = (plus_x + minus_x, minus_u) if negative >= 0 else (-minus_x, -minus_u)
        g = np.append(gx @ x + gu @ u, gx.sum() + gu.sum()).astype(np.float32)
        g[:-1] += decay * w[:-1]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1].astype(np.float64), float(w[-1])


def _matrix(rows: list[bytes], column: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.uint8)
    for k, blob in enumerate(rows):
        own = column[np.frombuffer(blob, np.int32)]
        out[k, own[own >= 0]] = 1
    return out


def _select(positive: list[bytes], unlabelled: list[bytes]) -> np.ndarray:
    """The features that mark the positives most clearly: by the z-score of their shares, at least LEAST_LIFT times as common there."""
    space = 1 << _LOG_SPACE
    count = np.zeros((2, space))
    for own, rows in zip(count, (positive, unlabelled), strict=True):
        for b in rows:
            own[np.frombuffer(b, np.int32)] += 1  # a row has each feature once
    n, m = len(positive), len(unlabelled)
    share = (count[0] + count[1]) / (n + m)
    z = (count[0] / n - count[1] / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m) + 1e-12)
    z[(count[0] + count[1] < 4) | (count[0] * m < LEAST_LIFT * count[1] * n)] = 0
    best = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    best = np.sort(best[z[best] > LEAST_Z])
    column = np.full(space, -1, np.int32)
    column[best] = np.arange(len(best))
    return column


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", usable: Column | None = None) -> Model:
    """Learns from the labels with ``toxic`` 1 and unlabelled documents; ``usable`` says of a doc_id whether it may be learnt from.

    prior: the share of toxic documents; by default that of 1 among the usable labels. Labels without doc_id or value
    are left out. Without positives or documents, the model gives the prior (0 if there are no labels) as every score.
    """
    prepare(docs.sparkSession)
    usable = usable if usable is not None else F.lit(True)
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(usable)
    n_positive, n_known = known.agg(F.count(F.when(F.col("toxic") == 1, 1)), F.count("*")).first()
    if prior is None:
        prior = n_positive / n_known if n_known else 0.0
    n_docs = docs.count()
    if not n_positive or not n_docs or not 0 < prior < 1:
        return Model(np.full(1 << _LOG_SPACE, -1, np.int32), np.zeros(1), float(np.log(max(prior, 1e-12) / max(1 - prior, 1e-12))))
    spot = (F.xxhash64(F.col("doc_id"), F.lit("sample")) / F.lit(2.0**64)) + 0.5  # in [0, 1)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL").filter(usable)
    positives = known.filter("toxic = 1").filter(spot < F.lit(MAX_POSITIVE / n_positive)).select("doc_id").distinct()
    chosen = with_few(rows, positives, "doc_id", 2 * MAX_POSITIVE).select(F.lit(1).alias("kind"), "text")
    others = rows.filter(spot < F.lit(MAX_UNLABELLED / n_docs)).select(F.lit(0).alias("kind"), "text")
    features = chosen.union(others).mapInArrow(_feature_sets, "kind int, features binary")
    found = features.orderBy(F.xxhash64("features"), "features", "kind").limit(2 * (MAX_POSITIVE + MAX_UNLABELLED)).collect()
    found = sorted((r.kind, bytes(r.features)) for r in found)  # the same order on every run
    positive, unlabelled = [f for k, f in found if k], [f for k, f in found if not k]
    if not positive or not unlabelled:
        return Model(np.full(1 << _LOG_SPACE, -1, np.int32), np.zeros(1), float(np.log(prior / (1 - prior))))
    column = _select(positive, unlabelled)
    width = int(column.max()) + 1
    weights, bias = nn_pu(_matrix(positive, column, width), _matrix(unlabelled, column, width), prior)
    return Model(column, weights if width else np.zeros(1), bias)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score), one row for each row of docs; null texts score as empty ones."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^18 entries and MAX_FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, raw, at in text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(shared.value.score(raw, at))], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def scorer(docs: DataFrame, model: Model):
    """A pandas UDF from text to score, for filters that keep whole rows."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxicity(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.empty(0), *[shared.value.score(raw, at) for _, _, raw, at in text_slices(text)]]))

    return toxicity


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, usable: Column | None = None) -> DataFrame:
    """The rows of docs that score below the threshold, with the columns of docs."""
    rows = docs.select(F.struct("*").alias("doc"), F.col("text").alias("body"))
    return rows.filter(scorer(docs, train(docs, labels, usable=usable))("body") < threshold).select("doc.*")
