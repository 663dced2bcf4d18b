"""Vectorised words, lines and shingles of whole texts (numpy, used inside Spark tasks).

Words are runs of bytes outside the ASCII blanks 0x20 and 0x09-0x0D; only A-Z are lower-cased.
Every function treats a null text as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Texts are worked on in chunks of about so many bytes; a longer text makes a chunk of its own.
CHUNK_BYTES = 2_000_000
SHINGLE = 5

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_MARK = np.isin(np.arange(256), [ord(c) for c in ".,!?;:"])
_LETTER = np.isin(np.arange(256) | 32, np.arange(ord("a"), ord("z") + 1)) & (np.arange(256) < 128)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(texts: Sequence[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts as UTF-8) for runs of texts of about `limit` bytes."""
    first, size, held = 0, 0, []
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > limit:
            yield first, held
            first, size, held = i, 0, []
        held.append(data)
        size += len(data)
    if held:
        yield first, held


class Words:
    """The words of a few texts: `start`/`end` byte offsets in `data`, `doc` index, `hash`.

    With `marks`, one of .,!?;: that ends a word after an ASCII letter is a word of its own.
    """

    def __init__(self, texts: Sequence[bytes], lower: bool = True, marks: bool = False):
        self.n = len(texts)
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        lens = np.fromiter(map(len, texts), np.int64, self.n)
        self.doc_at = np.cumsum(lens + 1) - lens - 1
        self.data = _LOWER[raw] if lower else raw
        blank = _BLANK[raw]
        edge = np.flatnonzero(np.diff(blank, prepend=True))
        self.start, self.end = edge[0::2], edge[1::2]
        if marks and len(self.end):
            ends = np.flatnonzero(_MARK[raw[self.end - 1]] & _LETTER[raw[self.end - 2]] & (self.end - self.start > 1))
            at = self.end[ends] - 1
            self.start, self.end = np.insert(self.start, ends + 1, at), np.insert(self.end, ends, at)
        self.doc = np.searchsorted(self.doc_at, self.start, side="right") - 1
        self.hash = span_hash(self.data, self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n).astype(np.int64)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """64-bit hash of each non-empty byte span (ascending, disjoint); another odd `base` gives another hash."""
    if not len(start):
        return np.empty(0, np.uint64)
    length = end - start
    take = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
    place = take - np.repeat(start, length)
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(length.max()), base))), dtype=np.uint64)
    values = (data[take].astype(np.uint64) + np.uint64(1)) * powers[place]
    heads = np.concatenate(([0], np.cumsum(length)[:-1]))
    return mix(np.add.reduceat(values, heads) + length.astype(np.uint64))


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive hashes; order matters."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * _STEP + hashes[k : k + n]
    return mix(total + np.uint64(width))


def shingles(words: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(doc index, hash) of every shingle in order; a shorter text with words is one shingle."""
    per = words.counts()
    first = np.cumsum(per) - per
    hashes = combine(words.hash, width)
    inside = words.doc[: len(hashes)] == words.doc[width - 1 :] if len(hashes) else np.empty(0, bool)
    docs, out = words.doc[: len(hashes)][inside], hashes[inside]
    short = np.flatnonzero((per > 0) & (per < width))
    if len(short):
        extra = np.array([combine(words.hash[first[d] : first[d] + per[d]], int(per[d]))[0] for d in short], np.uint64)
        docs, out = np.concatenate((docs, short)), np.concatenate((out, extra))
        order = np.argsort(docs, kind="stable")
        docs, out = docs[order], out[order]
    return docs, out


def shingle_sets(words: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(doc index, hash) of the distinct shingles, ascending within a text."""
    docs, hashes = shingles(words, width)
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[new], hashes[new]
