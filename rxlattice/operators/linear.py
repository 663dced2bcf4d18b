"""Logistic regression on sets of codes, where neither the vocabulary nor a vector of weights fits one machine.

The model and its steps are those of `ml.linear_model`: standardised features, a quadratic penalty, L-BFGS over the last
ten steps with a strong Wolfe search. What differs is where vectors live. Every vector of weights that L-BFGS forms is
a sum of X'q_k, with q_k the change of the residuals in round k, so a few coefficients say what it is, and products of
two such vectors come from q_j'XX'q_k. The driver holds these coefficients and products, some hundreds of numbers.
Residuals and margins lie in blocks of rows, X in blocks of rows and codes, and sums go between them by shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import saved

#: Most codes and most rows of a block, and about how many entries.
WIDTH = ROWS = 1 << 20
ENTRIES = 1 << 22
#: Steps that L-BFGS remembers; its search's conditions of decrease and of slope, and its most trials.
MEMORY, DECREASE, SLOPE, TRIALS = 10, 1e-4, 0.9, 10


@dataclass(frozen=True)
class Linear:
    """A fitted model: a table (code, weight) and the intercept."""

    weights: DataFrame
    intercept: float

    def score(self, df: DataFrame, id_: str = "patient_id") -> DataFrame:
        """id, label, score of rows (id, label, codes), one an id; a code without a weight counts for nothing."""
        known = df.select(id_, F.explode(F.array_distinct("codes")).alias("code")).join(self.weights, "code")
        # Summed in the order of the codes, so that equal sets have equal scores.
        total = F.aggregate(F.array_sort(F.collect_list(F.struct("code", "weight"))), F.lit(0.0), lambda s, c: s + c["weight"])
        margin = F.coalesce("_m", F.lit(0.0)) + F.lit(self.intercept)
        return df.select(id_, "label").join(known.groupBy(id_).agg(total.alias("_m")), id_, "left").select(id_, "label", (1 / (1 + F.exp(-margin))).alias("score"))


def fit(train: DataFrame, reg: float = 0.01, rounds: int = 20, tol: float = 1e-6, id_: str = "patient_id") -> Linear:
    """Fit on rows (id, label 0 or 1, codes), one an id; they are read several times, so `train` should be a table."""
    n, positives = train.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0))).first()
    if not n:
        raise ValueError("no rows to fit on")
    x = _Blocks(train, n, rounds + 1, id_)
    try:
        if positives in (0, n):  # one class: its score is certain
            return Linear(x.codes.select("code", F.lit(0.0).alias("weight")), float("inf") if positives else float("-inf"))
        at = _minimise(x, float(np.log(positives / (n - positives))), reg, rounds, tol)
        return Linear(saved(x.weights(at[:-1]), "weights"), float(at[-1] - at[:-1] @ x.means))
    finally:
        x.close()


# ---- the optimiser: vectors are coefficients of X'q_k, with the intercept's own number last


def _minimise(x: _Blocks, intercept: float, reg: float, rounds: int, tol: float) -> np.ndarray:
    def dot(a: np.ndarray, b: np.ndarray) -> float:
        return float(a[:-1] @ x.gram @ b[:-1] + a[-1] * b[-1])

    def gradient() -> np.ndarray:
        return np.append((np.arange(len(x.sums)) < x.kept) / x.n + reg * at[:-1], x.sums.sum() / x.n)

    def trial(there: np.ndarray, d: np.ndarray) -> tuple[float, float]:
        """Value and slope along d."""
        loss, slope = x.trial(there, d)
        pull = x.gram @ there[:-1]
        return loss / x.n + reg / 2 * float(there[:-1] @ pull), slope / x.n + reg * float(d[:-1] @ pull)

    at = np.append(np.zeros(len(x.sums)), intercept)
    value, _ = trial(at, 0 * at)
    x.keep()
    g = gradient()
    past: list[tuple[np.ndarray, np.ndarray]] = []
    done, failed = 0, False
    while done < rounds and dot(g, g) ** 0.5 > max(tol * abs(value), 1e-8):
        d = -_inverse(g, past, dot)
        start = at
        found = _search(lambda t: trial(start + t * d, d), value, dot(g, d), 1.0 if done else 1 / dot(d, d) ** 0.5)
        if found is None:
            if failed:
                break
            past, failed = [], True  # once more, with the memory cleared
            continue
        t, value = found
        x.keep()
        at, old = start + t * d, g
        g = gradient()
        past = [(t * d, g - old), *past][:MEMORY]
        done, failed = done + 1, False
    return at


def _inverse(g: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]], dot: Callable[[np.ndarray, np.ndarray], float]) -> np.ndarray:
    """The inverse Hessian that L-BFGS has of the past steps and changes of the gradient, times g."""
    d, shares = g.copy(), []
    for s, y in past:
        shares.append(dot(s, d) / dot(s, y))
        d = d - shares[-1] * y
    if past:
        s, y = past[0]
        d = d * (dot(s, y) / dot(y, y))
    for (s, y), share in zip(reversed(past), reversed(shares)):
        d = d + (share - dot(y, d) / dot(s, y)) * s
    return d


def _search(trial: Callable[[float], tuple[float, float]], value: float, slope: float, t: float) -> tuple[float, float] | None:
    """A step that meets the strong Wolfe conditions, and the value there, or None; the step is the last one tried."""
    if not slope <= 0:
        return None

    def between(a: tuple, b: tuple) -> float:
        """The least point of the cubic through both ends, not too near to either."""
        (t0, v0, s0), (t1, v1, s1) = sorted((a, b))
        u = s0 + s1 - 3 * (v0 - v1) / (t0 - t1)
        w = max(u * u - s0 * s1, 0.0) ** 0.5
        span = t1 - t0
        return min(max(t1 - span * (s1 + w - u) / (s1 - s0 + 2 * w), t0 + 0.1 * span), t0 + 0.9 * span)

    def zoom(low: tuple, high: tuple) -> tuple[float, float] | None:
        for _ in range(TRIALS):
            t = between(low, high)
            now = (t, *trial(t))
            if now[1] > value + DECREASE * t * slope or now[1] >= low[1]:
                high = now
                continue
            if abs(now[2]) <= SLOPE * abs(slope):
                return now[:2]
            if now[2] * (high[0] - low[0]) >= 0:
                high = low
            low = now
        return None

    low = (0.0, value, slope)
    for k in range(TRIALS):
        now = (t, *trial(t))
        if not np.isfinite(now[1]):
            t /= 2
            continue
        if now[1] > value + DECREASE * t * slope or (k and now[1] >= low[1]):
            return zoom(low, now)
        if abs(now[2]) <= SLOPE * abs(slope):
            return now[:2]
        if now[2] >= 0:
            return zoom(now, low)
        low, t = now, t * 1.5
    return None


# ---- rows and codes in blocks


class _Blocks:
    """X over (block of codes, block of rows), the residuals' changes q_k and the products XX'q_k over blocks of rows.

    Codes and rows are dealt to blocks by hash and numbered inside a block. Tables of one kind of block are dealt alike,
    so they meet where they are and a round moves only vectors: a block gets and sends a number for each of its rows
    and codes. Weights are those of centred, standardised features; `means` has what centring takes from XX'q_k.
    """

    def __init__(self, train: DataFrame, n: int, rounds: int, id_: str) -> None:
        self.n, self.kept = n, 0
        self.gram, self.sums, self.means = np.zeros((rounds, rounds)), np.zeros(rounds), np.zeros(rounds)
        each = F.explode(F.array_distinct("codes")).alias("code")
        counts = saved(train.select(each).where("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n")), "counts")
        n_codes, n_entries = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        self._wide = max(1, -(-n_codes // WIDTH))
        self._high = max(1, -(-n // ROWS), -(-n_entries // (self._wide * ENTRIES)))
        self.codes = saved(_numbered(counts, "code", self._wide, "b", "pos"), "codes")
        rows = _numbered(train.select(id_, "label", "codes"), id_, self._high, "p", "row")
        entries = rows.select("p", "row", each).join(self.codes.select("code", "b", "pos"), "code")
        self._held: list[RDD] = []
        self._x = self._hold(_packed(entries, F.col("b") * self._high + F.col("p"), "row", "pos", self._wide * self._high))
        self._y = self._hold(_packed(rows, F.col("p"), "row", "label", self._high).mapValues(lambda v: ("y", _dense(v))))
        self._n = self._hold(_packed(self.codes, F.col("b"), "pos", "n", self._wide).mapValues(lambda v: ("n", _dense(v))))
        self._lengths, self._widths = (dict(v.mapValues(lambda x: len(x[1])).collect()) for v in (self._y, self._n))
        # What a union reads is stored with its tag, as each step in Python between costs a worker a table.
        self._q: list[RDD] = []
        self._raw: list[RDD] = []
        self._kept: RDD | None = None
        self._tried: RDD | None = None

    def _hold(self, rdd: RDD) -> RDD:
        self._held.append(rdd.persist(StorageLevel.MEMORY_AND_DISK))
        return rdd

    def close(self) -> None:
        for rdd in (*self._held, self._kept, self._tried):
            if rdd is not None:
                rdd.unpersist()

    def trial(self, at: np.ndarray, along: np.ndarray) -> tuple[float, float]:
        """The sum of losses at `at` and its slope along `along`."""
        if self._tried is not None:
            self._tried.unpersist()
        rows = self._y if self._kept is None else self._y.union(self._kept.mapValues(lambda v: ("r", v[0])))
        for raw in self._raw:
            rows = rows.union(raw)
        lines = [(v[: self.kept], float(v[-1] - v[:-1] @ self.means)) for v in (at, along)]
        self._tried = rows.mapPartitions(lambda part: _tried(part, *lines), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        loss, slope, self._change = self._tried.map(lambda kv: kv[1][2]).reduce(np.add)
        return float(loss), float(slope)

    def keep(self) -> None:
        """Takes the residuals of the last trial: their change becomes q_k; XX'q_k and its products are formed."""
        k, before = self.kept, self._kept
        self._kept, self._tried = self._tried, None
        self._q.append(self._hold(self._kept.mapValues(lambda v: (k, v[1]))))
        self.sums[k] = self._change
        self._raw.append(self._hold(self._times(self._weights(self._q[k], self.sums[k])).mapValues(lambda v: (k, v))))
        rows = self._raw[k].mapValues(lambda v: ("raw", v[1]))
        for q in self._q:
            rows = rows.union(q)
        got = rows.mapPartitions(lambda part: _products(part, k + 1)).reduce(np.add)
        self.means[k] = got[-1] / self.n
        self.gram[k, : k + 1] = self.gram[: k + 1, k] = got[:-1] - self.means[k] * self.sums[: k + 1]
        self.kept += 1
        if before is not None:
            before.unpersist()

    def weights(self, shares: np.ndarray) -> DataFrame:
        """code, weight of the sum of X'q_k by `shares`."""
        rows = self._q[0]
        for q in self._q[1:]:
            rows = rows.union(q)
        whole = self._weights(rows.mapPartitions(lambda part: _mixed(part, shares)), float(shares @ self.sums))
        spark = self.codes.sparkSession
        table = spark.createDataFrame(whole.mapValues(lambda w: w.tobytes()), "b int, w binary").mapInArrow(_unpack, "b int, pos int, weight double")
        return self.codes.join(table, ["b", "pos"]).select("code", "weight")

    def _weights(self, q: RDD, total: float) -> RDD:
        """X'q by blocks of codes, less the codes' means times q's sum, over their variances."""
        wide, high, n, widths = self._wide, self._high, self.n, self._widths
        sent = q.flatMap(lambda kv: [(b * high + kv[0], kv[1][1]) for b in range(wide)]).partitionBy(wide * high, _place)
        sums = self._x.union(sent).mapPartitions(lambda part: _block_sums(part, high, widths, True)).reduceByKey(np.add, wide, _place)
        return self._n.union(sums).mapPartitions(lambda part: _scaled(part, total, n))

    def _times(self, weights: RDD) -> RDD:
        """X times weights, by blocks of rows."""
        wide, high, lengths = self._wide, self._high, self._lengths
        sent = weights.flatMap(lambda kv: [(kv[0] * high + p, kv[1]) for p in range(high)]).partitionBy(wide * high, _place)
        return self._x.union(sent).mapPartitions(lambda part: _block_sums(part, high, lengths, False)).reduceByKey(np.add, high, _place)


def _numbered(df: DataFrame, key: str, blocks: int, block: str, place: str) -> DataFrame:
    """`df` with the block of each row, by the hash of its key, and its place in the block."""
    dealt = df.withColumn(block, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    return dealt.withColumn(place, F.row_number().over(Window.partitionBy(block).orderBy(key)) - 1)


def _place(key: int) -> int:
    """The partition of a block."""
    return key


def _packed(df: DataFrame, key: Column, a: str, b: str, blocks: int) -> RDD:
    """(block, arrays a and b) for each block that has rows, in the order of (a, b)."""
    pieces = df.select(key.cast("int").alias("key"), F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b")).mapInArrow(_pack, "key int, a binary, b binary")
    return pieces.rdd.map(lambda r: (r[0], (bytes(r[1]), bytes(r[2])))).groupByKey(blocks, _place).mapValues(_whole)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, b) as pieces: one array of a and one of b, of some hundred thousand rows of a key at most."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    sizes: dict[int, int] = {}

    def piece(k: int) -> pa.RecordBatch:
        sizes.pop(k)
        a, b = (np.concatenate(v).astype(np.int32).tobytes() for v in zip(*held.pop(k)))
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([a], pa.binary()), pa.array([b], pa.binary())], ["key", "a", "b"])

    for batch in batches:
        keys, a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        order = np.argsort(keys, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1) if len(keys) else ():
            k = int(keys[part[0]])
            held.setdefault(k, []).append((a[part], b[part]))
            sizes[k] = sizes.get(k, 0) + len(part)
            if sizes[k] >= 1 << 18:
                yield piece(k)
    for k in list(held):
        yield piece(k)


def _whole(pieces: Iterator[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate([np.frombuffer(x, np.int32) for x in v]) for v in zip(*pieces))
    order = np.argsort(a.astype(np.int64) << 32 | b)
    return a[order], b[order]


def _dense(places: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Places 0, 1, ... are all there, so values in their order are the vector."""
    return places[1].astype(float)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b, w in zip(*(c.to_pylist() for c in batch.columns)):
            values = np.frombuffer(w)
            for k in range(0, len(values), 1 << 16):
                part = values[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), b, np.int32)), pa.array(np.arange(k, k + len(part), dtype=np.int32)), pa.array(part)], ["b", "pos", "weight"])


def _block_sums(part: Iterator, high: int, sizes: dict[int, int], by_code: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For a block of X and a vector over its rows (by_code) or codes: the vector's sums over its codes or rows."""
    blocks = {}
    for k, v in part:
        if isinstance(v, tuple):
            blocks[k] = v
            continue
        b, p = divmod(k, high)
        to = b if by_code else p
        if to in sizes:
            rows, codes = blocks.get(k, (np.zeros(0, np.int32),) * 2)
            own, other = (codes, rows) if by_code else (rows, codes)
            yield to, np.bincount(own, weights=v[other], minlength=sizes[to])


def _scaled(part: Iterator, total: float, n: int) -> Iterator[tuple[int, np.ndarray]]:
    counts = {}
    for b, v in part:
        if isinstance(v, tuple):
            counts[b] = v[1]
        else:
            mean = counts[b] / n
            varies = mean < 1
            yield b, np.where(varies, (v - mean * total) / np.where(varies, counts[b] * (1 - mean) / max(1, n - 1), 1), 0)


def _tried(part: Iterator, at: tuple[np.ndarray, float], along: tuple[np.ndarray, float]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For each block of rows: residuals, their change, (loss, slope, sum of the change)."""
    held: dict[int, list] = {}
    for p, (tag, v) in part:
        if tag == "y":
            held[p] = [v, 0.0, np.full(len(v), at[1]), np.full(len(v), along[1])]
        elif tag == "r":
            held[p][1] = v
        else:
            held[p][2] += at[0][tag] * v
            held[p][3] += along[0][tag] * v
    for p, (y, before, margin, slope) in held.items():
        r = np.exp(-np.logaddexp(0, -margin)) - y
        yield p, (r, r - before, np.array([(np.logaddexp(0, margin) - y * margin).sum(), r @ slope, (r - before).sum()]))


def _products(part: Iterator, n: int) -> Iterator[np.ndarray]:
    """Products of each q_j with the last XX'q_k, and the sum of that."""
    raw, got = {}, np.zeros(n + 1)
    for p, (tag, v) in part:
        if tag == "raw":
            raw[p] = v
            got[-1] += v.sum()
        elif p in raw:
            got[tag] += v @ raw[p]
    yield got


def _mixed(part: Iterator, shares: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    got: dict[int, np.ndarray] = {}
    for p, (k, v) in part:
        got[p] = got.get(p, 0.0) + shares[k] * v
    yield from ((p, ("mixed", v)) for p, v in got.items())
