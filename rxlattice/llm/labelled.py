"""Bounded training samples of labelled documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .near_dedup import SYMBOLS, signatures
from .text import Words, chunks, shingle_sets


#: Texts with so large a share (per cent) of common five-word shingles are near copies.
PERCENT = 80


def without_copies(rows: list[tuple[str, int]], percent: int = PERCENT) -> list[tuple[str, int]]:
    """The rows but for near copies of earlier ones, which would make their rare words look typical.

    Rows that share one of sixteen pairs of MinHash symbols are compared by their whole shingle sets.
    """
    by_key: dict[tuple[int, int, int], list[int]] = {}
    sets: list[np.ndarray] = []
    kept = []
    for first, texts in chunks([t for t, _ in rows]):
        docs, hashes = shingle_sets(Words(texts))
        at = np.searchsorted(docs, np.arange(len(texts) + 1))
        for i, symbols in enumerate(signatures(docs, hashes, len(texts)).tolist()):
            own = hashes[at[i] : at[i + 1]]
            keys = [(k, symbols[k], symbols[k + 1]) for k in range(0, SYMBOLS, 2)] if len(own) else []
            met = {j for key in keys for j in by_key.get(key, ())}
            if any(_alike(own, sets[j], percent) for j in met):
                continue
            for key in keys:
                by_key.setdefault(key, []).append(len(sets))
            sets.append(own)
            kept.append(rows[first + i])
    return kept


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def training_sample(docs: DataFrame, labels: DataFrame, label: Column, most: dict[int, int]) -> list:
    """Rows (text, label) of at most `most[v]` labelled documents for each label value v.

    The rows of least hash of their doc_id are taken, so the sample is fixed and its size has a bound;
    only their ids are joined to the texts, as a broadcast of that bound. Rows that repeat a doc_id count as
    one, with the least of their texts. Near copies are taken out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = None
    for value, n in sorted(most.items()):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    got = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).toArrow().to_pylist()
    return without_copies([(r["text"], r["label"]) for r in sorted(got, key=lambda r: r["doc_id"])])
