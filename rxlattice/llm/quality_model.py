"""Quality classifier: ordinal cumulative-link regression on hashed text features.

P(grade <= k) = logistic(threshold[k] - score), with one weight vector for all grades and ordered
thresholds (the first, then logs of the gaps, so the order holds by construction). The features are
hashed shares of byte trigrams and of four-grams of character kinds, over the whole text, with shares of
repeated words and lines. The model gives the expected grade and the tail probability P(grade >= 1).

No feature looks beyond its own text, so a text's score is the same, bit by bit, in whatever batch it stands.

Defined cases: null, empty and blank texts have no feature and get the score 0; without labelled rows, or
with one grade only, the model is flat and selects everything; repeated rows are scored alike; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune
from .labelled import training_sample
from .text import Words, chunks, mix

#: Weights, labelled documents of each grade that the fit may use, and steps of the fit.
BITS, MOST_PER_GRADE, STEPS = 14, 1500, 250
#: Documents with a smaller tail probability are rejected.
TAIL = 0.5
SCHEMA = "doc_id long, expected_grade double, tail_probability double, selected boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tail_probability", pa.float64()), ("selected", pa.bool_())])

#: Kinds of bytes: lower, upper, digit, blank, line end, other ASCII each by itself, beyond ASCII.
_KIND = np.arange(256, dtype=np.uint64)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[128:] = 4


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, hashed feature, value); values of one text add up to about 3."""
    words = Words(texts)
    n, raw = len(texts), words.data
    size = np.diff(np.append(words.doc_at, len(raw))) - 1
    doc = np.repeat(np.arange(n), size + 1)
    per = words.counts()
    out_doc, out_key, out_val = [], [], []
    for codes, width, salt in ((raw.astype(np.uint64), 3, 11), (_KIND[np.frombuffer(b" ".join(texts) + b" ", np.uint8)], 4, 12)):
        m = len(codes) - width + 1
        if m <= 0:
            continue
        key = np.zeros(m, np.uint64)
        for k in range(width):
            key = key * np.uint64(257) + codes[k : k + m]
        own = np.flatnonzero((doc[:m] == doc[width - 1 :]) & (per[doc[:m]] > 0))
        bucket = (mix(key[own] + np.uint64(salt << 56)) >> np.uint64(64 - BITS)).astype(np.int64)
        full, count = np.unique(doc[own] * (1 << BITS) + bucket, return_counts=True)
        owner = full >> BITS
        out_doc.append(owner)
        out_key.append(full & ((1 << BITS) - 1))
        out_val.append(np.sqrt(count / (size[owner] + 1)))
    some = np.flatnonzero(per)
    same = np.bincount(words.doc[1:][(words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])], minlength=n)
    order = np.lexsort((words.hash, words.doc))
    again = (words.hash[order][1:] == words.hash[order][:-1]) & (words.doc[order][1:] == words.doc[order][:-1])
    known = np.bincount(words.doc[order][1:][again], minlength=n)
    for slot, value in enumerate((same[some] / per[some], known[some] / per[some], 1 / np.sqrt(per[some]))):
        out_doc.append(some)
        out_key.append(np.full(len(some), (1 << BITS) + slot))
        out_val.append(value)
    return np.concatenate(out_doc), np.concatenate(out_key), np.concatenate(out_val)


_WIDTH = (1 << BITS) + 3


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def cumulative(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k), a column for each k below the highest grade."""
        return _logistic(self.thresholds[None, :] - score[:, None])

    def score(self, texts: list[bytes]) -> np.ndarray:
        doc, key, value = features(texts)
        return np.bincount(doc, self.weights[key] * value, minlength=len(texts))


def fit(rows: list[tuple[str, int]], grades: int, steps: int = STEPS, l2: float = 1e-4) -> Ordinal:
    """Maximum likelihood by Adam over the whole sample; each grade counts alike."""
    y = np.array([g for _, g in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return Ordinal(np.zeros(_WIDTH), np.linspace(-40, -20, grades - 1))
    docs, keys, values = [], [], []
    for first, texts in chunks([t for t, _ in rows]):
        d, k, v = features(texts)
        docs.append((d + first).astype(np.int32))
        keys.append(k.astype(np.int32))
        values.append(v)
    doc, key, value = np.concatenate(docs), np.concatenate(keys), np.concatenate(values)
    share = np.bincount(y, minlength=grades)
    weight = 1 / np.maximum(share, 1)[y] / (share > 0).sum()
    below = np.cumsum(np.where(share > 0, 1 / (share > 0).sum(), 0))[:-1].clip(0.02, 0.98)
    base = np.log(below / (1 - below))
    params = np.concatenate((np.zeros(_WIDTH), base[:1], np.log(np.maximum(np.diff(base), 0.05))))
    m1, m2 = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        grad = gradient(params, (doc, key, value), y, weight, l2)
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        params = params - 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Ordinal(params[:_WIDTH], _thresholds(params))


def _thresholds(params: np.ndarray) -> np.ndarray:
    """The first threshold and the gaps, which are stored as logs, added up."""
    return params[_WIDTH] + np.concatenate(([0], np.cumsum(np.exp(params[_WIDTH + 1 :]))))


def gradient(params: np.ndarray, x: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, weight: np.ndarray, l2: float) -> np.ndarray:
    """Of sum(-weight * log P(grade = y)) + l2 / 2 * |weights|^2, by weights, first threshold and logs of gaps."""
    (doc, key, value), theta = x, _thresholds(params)
    w, top = params[:_WIDTH], len(theta)
    s = np.bincount(doc, w[key] * value, minlength=len(y))
    up = np.where(y < top, _logistic(theta[np.minimum(y, top - 1)] - s), 1.0)
    low = np.where(y > 0, _logistic(theta[np.maximum(y, 1) - 1] - s), 0.0)
    p = np.maximum(up - low, 1e-9)
    du, dl = up * (1 - up), low * (1 - low)
    by_score = weight * (du - dl) / p
    by_theta = np.zeros(top)
    np.add.at(by_theta, np.minimum(y, top - 1), -weight * np.where(y < top, du / p, 0))
    np.add.at(by_theta, np.maximum(y, 1) - 1, weight * np.where(y > 0, dl / p, 0))
    tail = np.cumsum(by_theta[::-1])[::-1]
    return np.concatenate((np.bincount(key, by_score[doc] * value, minlength=_WIDTH) + l2 * w, tail[:1], tail[1:] * np.exp(params[_WIDTH + 1 :])))


def grade_column() -> F.Column:
    """Graded rating of a labels row: 0 for bad text, 1 for good text with toxic words, 2 for good text."""
    return F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).when(F.col("quality") == 1, 2)


def train(docs: DataFrame, labels: DataFrame, grades: int = 3, most: int = MOST_PER_GRADE) -> Ordinal:
    return fit(training_sample(docs, labels, grade_column(), dict.fromkeys(range(grades), most)), grades)


def score(docs: DataFrame, model: Ordinal, tail: float = TAIL) -> DataFrame:
    """doc_id, expected_grade, tail_probability, selected."""
    spark = tune(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch["text"].to_pylist()):
                below = sent.value.cumulative(sent.value.score(texts))
                ids = batch["doc_id"].slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array((1 - below).sum(1)), pa.array(1 - below[:, 0]), pa.array(1 - below[:, 0] >= tail)], schema=_ARROW)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def select_documents(docs: DataFrame, model: Ordinal, tail: float = TAIL) -> DataFrame:
    """The rows of `docs` that the model selects, with their columns as they are."""
    spark = tune(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [1 - sent.value.cumulative(sent.value.score(texts))[:, 0] >= tail for _, texts in chunks(batch["text"].to_pylist())]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, docs.schema)
