"""Size-partitioned MinHash containment search: short test items inside long documents.

Items are partitioned by the size of their shingle set (powers of two). For each partition a document is
cut into half-overlapping windows of twice that size, so a short item meets a window of about its own
size instead of the whole document, and their MinHash signatures (64 bins, one permutation) agree in
some bin unless at most one pair in about a million at the threshold is missed. Candidates are verified
by exact containment: the share of the item's distinct five-word shingles that the whole document has.

Items of fewer than five words have no such shingle: their whole sequence of words is looked for, as a word
n-gram of its own length, anywhere in a document.

The items' index is built by tasks, in blocks of about `BLOCK_BYTES` of item text, as sorted arrays in the
shared folder that workers memory-map. All blocks are held against a document in one pass over the documents,
where they are: nothing is shuffled, whatever the benchmark's size.

Defined cases: an item or text without words matches nothing; null ids pass through as null; repeated rows
give repeated results; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import load, save
from .common import shared_dir, tune
from .text import SHINGLE, Words, chunks, combine, mix, shingle_sets, shingles

PERCENT, BINS, BLOCK_BYTES = 80, 64, 16_000_000
_BIN_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
SCHEMA = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item_shingles", pa.int64()), ("n_shared", pa.int64()), ("containment", pa.float64())])


def _sorted(keys: list[np.ndarray], items: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """All keys, ascending, and the item of each."""
    key, item = np.concatenate(keys), np.repeat(items, [len(k) for k in keys])
    order = np.argsort(key, kind="stable")
    return key[order], item[order].astype(np.int32)


def _store_block(uri: str, ids: list, texts: list[str | None]) -> dict[str, list[int]]:
    """Write one block: ids, shingle sets and, by size partition or length in words, sorted keys with their items."""
    sets: list[np.ndarray] = []
    by_size: dict[int, tuple[list, list]] = {}
    by_length: dict[int, tuple[list, list]] = {}
    for first, part in chunks(texts):
        words = Words(part)
        per = words.counts().tolist()
        docs, hashes = shingle_sets(words)
        at = np.searchsorted(docs, np.arange(len(part) + 1))
        for i, n_words in enumerate(per):
            own = hashes[at[i] : at[i + 1]]
            sets.append(own)
            if not n_words:
                continue
            values, group, k = mix(own), by_size, (len(own) - 1).bit_length()
            if n_words < SHINGLE:
                group, k = by_length, n_words
            else:
                low = np.full(BINS, _NONE)
                np.minimum.at(low, (values >> _BIN_SHIFT).astype(np.int64), values)
                values = low[low != _NONE]
            keys, items = group.setdefault(k, ([], []))
            keys.append(values)
            items.append(first + i)
    save(f"{uri}-ids", np.array([0 if i is None else i for i in ids], np.int64))
    save(f"{uri}-null", np.array([i is None for i in ids], np.uint8))
    save(f"{uri}-at", np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int64))
    save(f"{uri}-sets", np.concatenate([*sets, np.empty(0, np.uint64)]))
    for name, group in (("size", by_size), ("length", by_length)):
        for k, rows in group.items():
            keys, items = _sorted(*rows)
            save(f"{uri}-{name}{k}", keys)
            save(f"{uri}-{name}{k}-items", items)
    return {"sizes": sorted(by_size), "lengths": sorted(by_length)}


class Block:
    """A stored block, memory-mapped."""

    def __init__(self, uri: str, sizes: list[int], lengths: list[int]):
        self.ids, self.null = load(f"{uri}-ids", "<i8"), load(f"{uri}-null", "u1")
        self.at, self.sets = load(f"{uri}-at", "<i8"), load(f"{uri}-sets", "<u8")
        self.sizes, self.lengths = ({k: (load(f"{uri}-{name}{k}", "<u8"), load(f"{uri}-{name}{k}-items", "<i4")) for k in ks} for name, ks in (("size", sizes), ("length", lengths)))

    def of(self, item: int) -> np.ndarray:
        return self.sets[self.at[item] : self.at[item + 1]]

    def id(self, item: int) -> int | None:
        return None if self.null[item] else int(self.ids[item])


def _hits(keys: np.ndarray, items: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in `wanted`, item) for every key that equals a wanted value."""
    low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
    n = high - low
    place = np.repeat(np.arange(len(wanted)), n)
    return place, items[low[place] + np.arange(len(place)) - (np.cumsum(n) - n)[place]]


def _may(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(42)).astype(np.int64)


class Index:
    """All blocks of a benchmark, as one worker sees them."""

    _last: tuple[str, Index] | None = None

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks
        self.seen = np.zeros(1 << 22, bool)
        for b in blocks:
            for keys, _ in b.sizes.values():
                self.seen[_may(keys)] = True
        self.sizes, self.lengths = (sorted({k for b in blocks for k in getattr(b, name)}) for name in ("sizes", "lengths"))

    @classmethod
    def of(cls, uri: str, facts: list[tuple[int, list[int], list[int]]]) -> Index:
        """The index below `uri`; a worker keeps the last one that it opened."""
        if cls._last is None or cls._last[0] != uri:
            cls._last = uri, cls([Block(f"{uri}/{k}", sizes, lengths) for k, sizes, lengths in facts])
        return cls._last[1]

    def candidates(self, values: np.ndarray) -> Iterator[tuple[Block, int]]:
        """Items that share a bin's least value with a window of a document, given by its shingles in order."""
        bins = (values >> _BIN_SHIFT).astype(np.int64)
        found: list[set[int]] = [set() for _ in self.blocks]
        for size in self.sizes:
            block = np.arange(len(values)) >> size
            low = np.full((int(block[-1]) + 2, BINS), _NONE)
            np.minimum.at(low, (block, bins), values)
            windows = np.minimum(low[:-1], low[1:])
            least = np.unique(windows[windows != _NONE])
            for b, out in zip(self.blocks, found):
                if size in b.sizes:
                    out.update(_hits(*b.sizes[size], least)[1].tolist())
        for b, out in zip(self.blocks, found):
            yield from ((b, item) for item in sorted(out))

    def search(self, texts: list[bytes], percent: int) -> Iterator[tuple[int, int | None, int, int]]:
        """(index of the text, item id, the item's shingles, shared ones)."""
        words = Words(texts)
        docs, hashes = shingles(words)
        values = mix(hashes)
        for doc in np.unique(docs[self.seen[_may(values)]]):
            a, b = np.searchsorted(docs, [doc, doc + 1])
            own = None
            for block, item in self.candidates(values[a:b]):
                own = np.unique(hashes[a:b]) if own is None else own
                wanted = block.of(item)
                shared = len(np.intersect1d(wanted, own, assume_unique=True))
                if 100 * shared >= percent * len(wanted):
                    yield int(doc), block.id(item), len(wanted), shared
        for width in self.lengths:
            runs = combine(words.hash, width)
            n = len(runs)
            inside = np.flatnonzero(words.doc[:n] == words.doc[width - 1 :]) if n else np.empty(0, np.int64)
            keys = mix(runs[inside])
            for block in self.blocks:
                if width in block.lengths:
                    place, item = _hits(*block.lengths[width], keys)
                    for doc, i in sorted(set(zip(words.doc[inside[place]].tolist(), item.tolist()))):
                        yield doc, block.id(i), 1, 1


def build(items: DataFrame) -> tuple[str, list[tuple[int, list[int], list[int]]]]:
    """Write the index of all items; its folder and, of each block, number, sizes and lengths (short lists)."""
    spark = tune(items.sparkSession)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    uri = shared_dir(spark, "items")
    # Copies of an item are dealt by their place, so no block gets more than its share.
    dealt = rows.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int"))

    def store(key: tuple, part: pa.Table) -> pa.Table:
        facts = _store_block(f"{uri}/{key[0].as_py()}", part["item_id"].to_pylist(), part["text"].to_pylist())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), **{k: pa.array([v], pa.list_(pa.int32())) for k, v in facts.items()}})

    done = dealt.groupBy("block").applyInArrow(store, "block int, sizes array<int>, lengths array<int>").collect()
    return uri, [(r["block"], list(r["sizes"]), list(r["lengths"])) for r in sorted(done)]


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document and item whose shingles it has to `percent` or more."""
    tune(docs.sparkSession)
    uri, facts = build(items)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index.of(uri, facts)
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            found = [(ids[first + d], item, n, k, k / n) for first, texts in chunks(batch["text"].to_pylist()) for d, item, n, k in own.search(texts, percent)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _ARROW.types)], schema=_ARROW) if found else pa.RecordBatch.from_pylist([], _ARROW)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(find, SCHEMA)


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` whose text contains no item, with their columns as they are."""
    tune(docs.sparkSession)
    uri, facts = build(items)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index.of(uri, facts)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, texts in chunks(batch["text"].to_pylist()):
                for d, *_ in own.search(texts, percent):
                    keep[first + d] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)
