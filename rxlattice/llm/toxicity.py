"""Toxic spans by a linear-chain conditional random field over the words of each sentence.

Chains are whole sentences, however long. A word's state features are its letters, their prefixes of
3 to 6 and their last three, hashed; two states (0 clean, 1 toxic) and a 2 x 2 transition matrix make the
chain. Documents have one label each, so training words get theirs first: a word of a toxic document is
toxic if one of its features occurs in toxic training documents far more often than in others. Word
weights and transitions are then fitted by likelihood, with forward-backward marginals.

A document's score is a logistic function, fitted on the training documents, of its largest marginal and
of the sum of marginals, as such and per word; the offending words' code-point offsets come with it.

Defined cases: null and empty texts have no word and get the score of a text without any toxic word;
without training rows, or with one label only, every score is the share of toxic training rows (0 if
none); repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tune
from .labelled import training_sample
from .text import Words, chunks, mix, span_hash

BITS, PREFIXES, ROUNDS = 18, (3, 4, 5, 6), 30
#: Chains of more words are walked one by one, word by word; shorter ones side by side.
LONG = 400
#: Labelled training documents of each label that the fit may use.
MOST = {0: 3000, 1: 1500}
#: A feature marks a toxic word if it is in so many toxic documents (and such a share of them) and so much
#: likelier in them (log).
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 3, 0.005, 3.0
PREDICT = 0.7
SCHEMA = "doc_id long, score double, predicted int, spans array<struct<start:long,end:long,marginal:double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", _SPANS)])

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])


class Tagged:
    """Words of some texts with their hashed features (one row each) and their chains."""

    def __init__(self, texts: list[bytes]):
        self.words = w = Words(texts)
        n = len(w.start)
        letter = np.concatenate(([0], np.cumsum(_LETTER[w.data])))
        start, end = w.start.copy(), w.end.copy()
        if n:
            # Letters only: marks around a word are trimmed, those inside stay.
            position = np.where(_LETTER[w.data], np.arange(len(w.data)), -1)
            last = np.maximum.accumulate(position)[end - 1]
            nexts = np.where(_LETTER[w.data], np.arange(len(w.data)), len(w.data))
            first = np.minimum.accumulate(nexts[::-1])[::-1][start]
            some = letter[end] > letter[start]
            start, end = np.where(some, first, start), np.where(some, last + 1, end)
        columns = [span_hash(w.data, start, end)]
        columns += [span_hash(w.data, start, np.minimum(start + k, end)) + np.uint64(k) for k in PREFIXES]
        columns.append(span_hash(w.data, np.maximum(end - 3, start), end) + np.uint64(99))
        self.features = np.stack([(mix(c) >> np.uint64(64 - BITS)).astype(np.int32) for c in columns], 1) if n else np.empty((0, len(columns)), np.int32)
        fresh = np.ones(n, bool)
        if n:
            broken = np.concatenate(([0], np.cumsum(w.data == 0x0A)))
            fresh[1:] = (w.doc[1:] != w.doc[:-1]) | _STOP[w.data[w.end[:-1] - 1]] | (broken[w.start[1:]] > broken[w.end[:-1]])
        self.head = np.flatnonzero(fresh)
        self.length = np.diff(np.append(self.head, n))

    def slim(self) -> Tagged:
        """Without the bytes: what training needs."""
        self.words.data = self.words.data[:0]
        return self


def _soft(a: np.ndarray | float, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def _walk(emit: list[float], first: float, a: list[list[float]], back: bool) -> list[float]:
    """Messages along one chain: `first` at its start, then forward (or backward) from word to word."""

    def soft(x: float, y: float) -> float:
        return max(x, y) + math.log1p(math.exp(-abs(x - y)))

    out = [first]
    for e in emit:
        x = out[-1]
        if back:
            out.append(soft(a[1][0], a[1][1] + e + x) - soft(a[0][0], a[0][1] + e + x))
        else:
            out.append(e + soft(a[0][1], x + a[1][1]) - soft(a[0][0], x + a[1][0]))
    return out


def forward_backward(emit: np.ndarray, head: np.ndarray, length: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal of state 1 for each word, summed pair marginals (2 x 2), and log odds passed on.

    emit: log odds of state 1 for each word; a: transition weights from state to state.
    """
    order = np.argsort(-length, kind="stable")
    head, length = head[order], length[order]
    alpha, beta = emit.copy(), np.zeros_like(emit)
    n_long, steps = int((length > LONG).sum()), a.tolist()
    for h, n in zip(head[:n_long].tolist(), length[:n_long].tolist()):
        own = emit[h : h + n].tolist()
        alpha[h : h + n] = _walk(own[1:], own[0], steps, False)
        beta[h : h + n] = _walk(own[:0:-1], 0.0, steps, True)[::-1]
    inner = np.ones(len(emit), bool)
    inner[head] = False
    head, length = head[n_long:], length[n_long:]
    longest = int(length[0]) if len(length) else 0
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(longest + 1)]  # chains longer than t
    for t in range(1, longest):
        now = head[: active[t]] + t
        before = alpha[now - 1]
        alpha[now] += _soft(a[0, 1], before + a[1, 1]) - _soft(a[0, 0], before + a[1, 0])
    for t in range(longest - 2, -1, -1):
        now = head[: active[t + 1]] + t
        after = emit[now + 1] + beta[now + 1]
        beta[now] = _soft(a[1, 0], a[1, 1] + after) - _soft(a[0, 0], a[0, 1] + after)
    marginal = 1 / (1 + np.exp(-np.clip(alpha + beta, -40, 40)))
    at = np.flatnonzero(inner)
    pairs = np.zeros((2, 2))
    if len(at):
        logs = np.stack([a[i, j] + i * alpha[at - 1] + j * (emit[at] + beta[at]) for i in (0, 1) for j in (0, 1)])
        logs -= logs.max(0)
        weight = np.exp(logs)
        pairs = (weight / weight.sum(0)).sum(1).reshape(2, 2)
    return marginal, pairs, at


@dataclass
class Field:
    weights: np.ndarray
    bias: float
    transitions: np.ndarray
    link: np.ndarray  # of the document's score: constant, largest marginal, logs of the sum and of its share

    def tag(self, tagged: Tagged) -> np.ndarray:
        if not len(tagged.words.start):
            return np.empty(0)
        emit = self.weights[tagged.features].sum(1) + self.bias
        return forward_backward(emit, tagged.head, tagged.length, self.transitions)[0]

    def scores(self, tagged: Tagged, marginal: np.ndarray) -> np.ndarray:
        x = _summary(tagged, marginal)
        return 1 / (1 + np.exp(-np.clip(x @ self.link, -40, 40)))


def _summary(tagged: Tagged, marginal: np.ndarray) -> np.ndarray:
    n = tagged.words.n
    most, total = np.zeros(n), np.zeros(n)
    np.maximum.at(most, tagged.words.doc, marginal)
    np.add.at(total, tagged.words.doc, marginal)
    share = 1000 * total / np.maximum(tagged.words.counts(), 1)
    return np.stack([np.ones(n), most, np.log1p(total), np.log1p(share)], 1)


def _flat(rate: float) -> Field:
    odds = np.log(max(rate, 1e-12) / max(1 - rate, 1e-12))
    return Field(np.zeros(1 << BITS), -40.0, np.zeros((2, 2)), np.array([odds, 0.0, 0.0, 0.0]))


def word_labels(parts: list[Tagged], toxic: list[np.ndarray]) -> list[np.ndarray]:
    """1 for the words of toxic documents that have a feature typical of such documents."""
    inside, outside = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for tagged, bad in zip(parts, toxic):
        seen = np.unique((tagged.features.astype(np.int64) * tagged.words.n + tagged.words.doc[:, None]).reshape(-1))
        feature, doc = seen // tagged.words.n, seen % tagged.words.n
        inside += np.bincount(feature[bad[doc] == 1], minlength=1 << BITS)
        outside += np.bincount(feature[bad[doc] == 0], minlength=1 << BITS)
    n_bad, n_all = sum(int(b.sum()) for b in toxic), sum(map(len, toxic))
    odds = np.log((inside + 0.5) / (n_bad + 1)) - np.log((outside + 0.5) / (n_all - n_bad + 1))
    typical = (odds >= LEAST_ODDS) & (inside >= max(LEAST_DOCS, LEAST_SHARE * n_bad))
    return [(typical[t.features].any(1) & (b[t.words.doc] == 1)).astype(float) for t, b in zip(parts, toxic)]


def fit(rows: list[tuple[str, int]], rounds: int = ROUNDS) -> Field:
    """Fit on labelled texts, worked on in chunks so that memory follows the words, not their bytes."""
    labels = np.array([label for _, label in rows], np.int64)
    if not len(rows) or labels.min() == labels.max():
        return _flat(float(labels.mean()) if len(rows) else 0.0)
    parts, toxic = [], []
    for first, texts in chunks([t for t, _ in rows]):
        parts.append(Tagged(texts).slim())
        toxic.append(labels[first : first + len(texts)])
    ys = word_labels(parts, toxic)
    held = np.zeros((2, 2))
    for tagged, y in zip(parts, ys):
        inner = np.ones(len(y), bool)
        inner[tagged.head] = False
        at = np.flatnonzero(inner)
        held += np.bincount((2 * y[at - 1] + y[at]).astype(int), minlength=4).reshape(2, 2)
    rate = max(sum(y.sum() for y in ys) / max(sum(map(len, ys)), 1), 1e-6)
    model = Field(np.zeros(1 << BITS), float(np.log(rate / (1 - rate))), np.zeros((2, 2)), np.zeros(4))
    squares, square_t = np.full(1 << BITS, 1e-6), np.full((2, 2), 1e-6)
    for _ in range(rounds):
        grad, step = -0.01 * model.weights, held.copy()
        for tagged, y in zip(parts, ys):
            emit = model.weights[tagged.features].sum(1) + model.bias
            marginal, pairs, _ = forward_backward(emit, tagged.head, tagged.length, model.transitions)
            for column in tagged.features.T:
                grad += np.bincount(column, y - marginal, minlength=1 << BITS)
            step -= pairs
        squares += grad * grad
        model.weights += 1.0 * grad / np.sqrt(squares)
        square_t += step * step
        model.transitions += 0.3 * step / np.sqrt(square_t)
    x, toxic = np.concatenate([_summary(t, model.tag(t)) for t in parts]), labels
    for _ in range(25):  # Newton's method; documents of both labels count alike
        p = 1 / (1 + np.exp(-np.clip(x @ model.link, -40, 40)))
        weight = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (toxic == 0).sum())
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(4)
        model.link = model.link + np.linalg.solve(hessian, x.T @ (weight * (toxic - p)) - 1e-4 * model.link)
    return model


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: dict[int, int] = MOST) -> Field:
    """Fit on labelled documents outside the held-out third."""
    return fit(training_sample(docs, labels.where(~held_out()), F.col("toxic"), most))


def score(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, score, predicted, spans (code-point offsets of words with a marginal of 0.5 or more)."""
    spark = tune(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch["text"].to_pylist()):
                tagged = Tagged(texts)
                marginal = sent.value.tag(tagged)
                scores = sent.value.scores(tagged, marginal)
                spans: list[list] = [[] for _ in texts]
                words = tagged.words
                hit = np.flatnonzero(marginal >= 0.5)
                if len(hit):
                    points = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
                    for i in hit:
                        at = points[words.doc_at[words.doc[i]]]
                        spans[words.doc[i]].append({"start": int(points[words.start[i]] - at), "end": int(points[words.end[i]] - at), "marginal": float(marginal[i])})
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, len(texts)), pa.array(scores), pa.array((scores >= PREDICT).astype(np.int32)), pa.array(spans, _SPANS)], schema=_ARROW)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
