"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

Tokens are lower-cased words and one end per text; a text begins after a start mark. The model is a folder
of raw little-endian arrays, in shards of about equal size:

* words: sorted 64-bit word hashes, cut into shards by their high bits; a word's number is its place.
  Beside them: its count, its continuation count (distinct words before it), and of the words after it
  the total and how many distinct ones follow once, twice, and more often.
* pairs: sorted keys (number of the first word << 32 | number of the second) and their counts, dealt by hash.

Counting takes two passes over the corpus: words, then pairs by number. Every task counts its own rows
first and sends each shard a sorted, packed block; a shard's task merges its blocks and writes its arrays
under a new name, renamed when whole, so a lost executor costs a task. There is a shard for each `SHARD_BYTES`
of text, so what a task merges stays the same however large the corpus is. Counts take the narrowest type
that holds them, up to 64 bits. The driver sees one short row for each shard. Discounts come from all counts of counts. Scoring looks a batch's distinct pairs up at once.

Defined cases: a null text is empty and has the end token only; without training rows every word has the
same probability; null doc_ids are scored, and train as the remainder of no number; repeated rows count
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import exists, load, save
from .common import shared_dir, tune
from .text import Words, chunks, mix

END, START = (mix(np.array([k], np.uint64))[0] for k in (0xE0D, 0x57A27))
#: Pairs that a task counts before it sends them on.
HELD = 6_000_000
#: Bytes of text for which the model gets a shard.
SHARD_BYTES = 64_000_000
_STATS = ("count", "before", "after", "once", "twice", "more")

SCHEMA = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
_ARROW = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.float64()) for c in SCHEMA.split(", ")])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


# ---- packed blocks: sorted keys with counts


def _squeeze(a: np.ndarray) -> bytes:
    """Bytes of equal place beside each other, deflated: neighbours in sorted keys share their high bytes."""
    return zlib.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes(), 1)


def _spread(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def _narrow(count: np.ndarray) -> np.ndarray:
    """The counts as the narrowest unsigned type that holds them all."""
    return count.astype(np.min_scalar_type(int(count.max()) if count.size else 0))


def _spread_counts(data: bytes, n: int, columns: int = 1) -> np.ndarray:
    """int64 counts of n keys, `columns` of each, whatever their packed type."""
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    width = len(raw) // (n * columns)
    got = np.ascontiguousarray(raw.reshape(width * columns, -1).T).reshape(-1).view(f"<u{width}").astype(np.int64)
    return got if columns == 1 else got.reshape(n, columns)


def _unpacked(rows: pd.DataFrame, columns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and summed counts of a shard's blocks."""
    keys = [_spread(k, np.uint64) for k in rows["keys"]]
    return _merge(keys, [_spread_counts(c, len(k), columns) for c, k in zip(rows["counts"], keys)])


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts (rows of `counts` if they have several)."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    if not len(key):
        return key, count
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[head], np.add.reduceat(count[order], head)


_BLOCK = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_BLOCK_DDL = "shard int, keys binary, counts binary"


def _blocks(key: np.ndarray, count: np.ndarray, shard: np.ndarray, n: int) -> pa.RecordBatch:
    order = np.argsort(shard, kind="stable")
    at = np.searchsorted(shard[order], np.arange(n + 1))
    rows = [(s, _squeeze(key[o]), _squeeze(_narrow(count[o]))) for s in range(n) if len(o := order[at[s] : at[s + 1]])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BLOCK.types)], schema=_BLOCK) if rows else pa.RecordBatch.from_pylist([], _BLOCK)


def _by_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Shard of a word hash: even cuts of the whole range, so shards follow each other in order."""
    return ((words >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _by_pair(keys: np.ndarray, n: int) -> np.ndarray:
    return _by_hash(mix(keys), n)


def _streams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc index, hash of the word before, hash of the token) of all tokens with the ends, in order."""
    words = Words(texts)
    per = words.counts()
    first = np.cumsum(per + 1) - per - 1
    token = np.full(len(words.hash) + len(texts), END, np.uint64)
    at = np.arange(len(words.hash)) + words.doc
    token[at] = words.hash
    doc = np.repeat(np.arange(len(texts)), per + 1)
    before = np.roll(token, 1)
    before[first] = START
    return doc, before, token


@dataclass
class Model:
    uri: str
    shards: int
    starts: np.ndarray  # number of the first word of each word shard
    n: int
    distinct: int
    pairs: int = 0
    discount: tuple[float, float, float] = (0.5, 1.0, 1.5)
    discount_low: tuple[float, float, float] = (0.5, 1.0, 1.5)
    types: tuple[int, int, int] = (0, 0, 0)  # words found after one, two, more distinct words
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    def array(self, name: str, shard: int, kind: str) -> np.ndarray:
        if (name, shard) not in self._open:
            self._open[name, shard] = load(f"{self.uri}/{name}-{shard}", kind)
        return self._open[name, shard]

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The numbers of ascending word hashes; -1 for a word that isn't known."""
        out = np.full(len(words), -1, np.int64)
        cut = np.searchsorted(_by_hash(words, self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():  # a shard is opened only for a word that lies in it
            part = words[cut[s] : cut[s + 1]]
            known = self.array("words", s, "<u8")
            if len(known):
                at = np.minimum(np.searchsorted(known, part), len(known) - 1)
                out[cut[s] : cut[s + 1]] = np.where(known[at] == part, at + self.starts[s], -1)
        return out

    def stats(self, numbers: np.ndarray) -> np.ndarray:
        """Rows of _STATS of known words, given by ascending numbers."""
        out = np.zeros((len(numbers), len(_STATS)), np.int64)
        cut = np.append(np.searchsorted(numbers, self.starts), len(numbers))
        for s in range(self.shards):
            if cut[s] < cut[s + 1]:
                out[cut[s] : cut[s + 1]] = self.array("stats", s, "<i8").reshape(-1, len(_STATS))[numbers[cut[s] : cut[s + 1]] - self.starts[s]]
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        shard = _by_pair(keys, self.shards)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in range(self.shards):
            if cut[s] < cut[s + 1]:
                mine = order[cut[s] : cut[s + 1]]
                known = self.array("pairs", s, "<u8")
                if len(known):
                    at = np.minimum(np.searchsorted(known, keys[mine]), len(known) - 1)
                    raw = self.array("counts", s, "u1")
                    out[mine] = np.where(known[at] == keys[mine], raw.view(f"<u{len(raw) // len(known)}")[at], 0)
        return out

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        doc, before, token = _streams(texts)
        n = len(texts)
        words, back = np.unique(np.concatenate((before, token)), return_inverse=True)
        number = self.numbers(words)
        known = number >= 0
        stats = np.zeros((len(words), len(_STATS)), np.int64)
        stats[known] = self.stats(number[known])
        # Words as they continue: modified Kneser-Ney over distinct words before, down to an even share.
        low = np.array((0.0, *self.discount_low))
        spare = float(np.dot(self.discount_low, self.types))
        pairs = max(self.pairs, 1)
        single = np.maximum(stats[:, 1] - low[np.minimum(stats[:, 1], 3)], 0) / pairs
        single += (spare / pairs if self.pairs else 1.0) / (self.distinct + 1)
        first, second = back[: len(before)], back[len(before) :]
        pair, again = np.unique(first.astype(np.int64) * len(words) + second, return_inverse=True)
        a, b = pair // len(words), pair % len(words)
        count = np.zeros(len(pair), np.int64)
        both = known[a] & known[b]
        count[both] = self.pair_counts((number[a[both]].astype(np.uint64) << np.uint64(32)) | number[b[both]].astype(np.uint64))
        high = np.array((0.0, *self.discount))
        total = np.maximum(stats[a, 2], 1)
        left = (stats[a, 3:] * np.array(self.discount)).sum(1) / total
        p = np.where(stats[a, 2] > 0, np.maximum(count - high[np.minimum(count, 3)], 0) / total + left * single[b], single[b])
        base = np.log10((stats[:, 0] + 1) / (self.n + self.distinct + 1))
        out = {"n_tokens": np.bincount(doc, minlength=n).astype(np.int64)}
        out["n_known"] = np.bincount(doc, stats[second, 0] > 0, minlength=n).astype(np.int64)
        out["base_score"] = np.bincount(doc, base[second], minlength=n)
        out["score"] = np.bincount(doc, np.log10(p)[again], minlength=n)
        return out


def _discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from counts of counts; kept inside (0, k) for small data."""
    n1, n2, n3, n4 = (max(x, 1) for x in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _counts_of_counts(count: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(count, 5), minlength=6)[1:5].tolist()


def _report(shard: int, numbers: list[int]) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "numbers": [[int(x) for x in numbers]]})


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _flush(keys: list, counts: list, shard_of, n: int) -> pa.RecordBatch:
    key, count = _merge(keys, counts)
    keys.clear()
    counts.clear()
    return _blocks(key, count, shard_of(key, n), n)


def train(docs: DataFrame, shards: int | None = None) -> Model:
    """Count all rows of `docs` into a new model. The number of shards follows the bytes of text."""
    spark = tune(docs.sparkSession)
    texts = _texts(docs).select("text")
    size = 0 if shards else texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    uri = shared_dir(spark, "lm")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for _, part in chunks(batch["text"].to_pylist()):
                token, count = np.unique(_streams(part)[2], return_counts=True)
                keys += [token, np.array([START])]
                counts += [count, np.zeros(1, np.int64)]
                held += len(token)
            if held > HELD:
                merged = _merge(keys, counts)
                keys, counts, held = [merged[0]], [merged[1]], 0
                if len(merged[0]) > HELD:
                    yield _flush(keys, counts, _by_hash, n)
        if keys:
            yield _flush(keys, counts, _by_hash, n)

    def merge_words(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        words, count = _unpacked(rows)
        save(f"{uri}/words-{key[0]}", words)
        save(f"{uri}/only-{key[0]}", count)
        return _report(key[0], [len(words), int(count.sum()), int((count > 0).sum())])

    found = {r["shard"]: r["numbers"] for r in texts.mapInArrow(count_words, _BLOCK_DDL).groupBy("shard").applyInPandas(merge_words, "shard int, numbers array<long>").collect()}
    for s in set(range(n)) - set(found):
        save(f"{uri}/words-{s}", np.empty(0, np.uint64))
        save(f"{uri}/only-{s}", np.empty(0, np.int64))
        save(f"{uri}/stats-{s}", np.empty(0, np.int64))
    sizes = [found.get(s, [0, 0, 0]) for s in range(n)]
    total = sum(x[0] for x in sizes)
    if total >= 1 << 32:
        raise ValueError("pairs of word numbers have 32 bits each: more than 2**32 distinct words")
    model = Model(uri, n, np.cumsum([0, *(x[0] for x in sizes)])[:-1], sum(x[1] for x in sizes), sum(x[2] for x in sizes))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for _, part in chunks(batch["text"].to_pylist()):
                _, before, token = _streams(part)
                words, back = np.unique(np.concatenate((before, token)), return_inverse=True)
                number = model.numbers(words).astype(np.uint64)[back]
                pair, count = np.unique((number[: len(before)] << np.uint64(32)) | number[len(before) :], return_counts=True)
                keys.append(pair)
                counts.append(count)
                held += len(pair)
            if held > HELD:
                yield _flush(keys, counts, _by_pair, n)
                held = 0
        if keys:
            yield _flush(keys, counts, _by_pair, n)

    def merge_pairs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Write the shard's pairs; pass on, for each word shard, what its words get from them."""
        pair, count = _unpacked(rows)
        save(f"{uri}/pairs-{key[0]}", pair)
        save(f"{uri}/counts-{key[0]}", _narrow(count))
        a, b = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        kind = np.minimum(count, 3)
        after = np.stack([np.zeros(len(a), np.int64), count, kind == 1, kind == 2, kind == 3], 1).astype(np.int64)
        before = np.zeros((len(b), 5), np.int64)
        before[:, 0] = 1
        number, stats = _merge([a, b], [after, before])
        out = _blocks(number.astype(np.uint64), stats, np.searchsorted(model.starts, number, side="right") - 1, n).to_pandas()
        out["numbers"] = None
        return pd.concat([out, pd.DataFrame({"shard": [-1], "keys": [b""], "counts": [b""], "numbers": [[*_counts_of_counts(count), len(pair)]]})])

    blocks = texts.mapInArrow(count_pairs, _BLOCK_DDL).groupBy("shard").applyInPandas(merge_pairs, _BLOCK_DDL + ", numbers array<long>")

    def merge_stats(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return _report(-1, np.array(rows["numbers"].tolist(), np.int64).sum(0).tolist())
        number, stats = _unpacked(rows, 5)
        out = np.zeros((sizes[key[0]][0], len(_STATS)), np.int64)
        out[:, 0] = load(f"{uri}/only-{key[0]}", "<i8")
        out[number.astype(np.int64) - model.starts[key[0]], 1:] = stats
        save(f"{uri}/stats-{key[0]}", out)
        seen = out[:, 1]
        return _report(key[0], [*_counts_of_counts(seen), *(int((np.minimum(seen, 3) == k).sum()) for k in (1, 2, 3))])

    reports = blocks.groupBy("shard").applyInPandas(merge_stats, "shard int, numbers array<long>").collect()
    for s in range(n):
        if not exists(f"{uri}/pairs-{s}"):
            save(f"{uri}/pairs-{s}", np.empty(0, np.uint64))
            save(f"{uri}/counts-{s}", np.empty(0, np.uint32))
    high = next((r["numbers"] for r in reports if r["shard"] < 0), [0] * 5)
    low = np.array([r["numbers"] for r in reports if r["shard"] >= 0] or [[0] * 7]).sum(0).tolist()
    model.pairs = high[4]
    model.discount, model.discount_low = _discounts(*high[:4]), _discounts(*low[:4])
    model.types = tuple(low[4:])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity of every text."""
    spark = tune(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for first, part in chunks(batch["text"].to_pylist()):
                got = own.score(part)
                got["doc_id"] = batch["doc_id"].slice(first, len(part))
                got["train_tokens"] = np.full(len(part), own.n, np.int64)
                got["perplexity"] = 10 ** np.minimum(-got["score"] / got["n_tokens"], 300)
                yield pa.RecordBatch.from_arrays([got[k] if isinstance(got[k], pa.Array) else pa.array(got[k], t) for k, t in zip(_ARROW.names, _ARROW.types)], schema=_ARROW)

    return _texts(docs).mapInArrow(run, SCHEMA)
