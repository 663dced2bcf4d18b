"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback splits each word; a text's characters per token, share of byte
tokens and entropy of its tokens (bits) say how far it is from language that the vocabulary knows. A text
outside a band is rejected. The base rules (words, repeated words) come first.

The bands come from the corpus: one aggregate takes the quartiles of all texts that pass the base rules, per
script, language and size (entropy grows with a text's length), per script and language, and per script. A
group's band reaches from the median `BELOW` and `ABOVE` deviations, each side by its own quartile; the share of byte
tokens is bounded above only, as fewer of them are never worse. Every group counts, with the weight of its texts: its
edges are drawn towards those of the group around it as if that held `WEIGHT` texts more, the script's towards the
fixed limits. So a band grows out of the corpus by degrees and no text is judged by another rule because its group is
small. The fixed limits per script hold besides, always.

Defined cases: a null, empty or blank text has no word, fails the base rule and has 0 for all measures;
the script of a text without letters is `other`; a null or missing lang is the language ''; repeated rows are measured alike; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tune
from .text import Words, chunks, combine
from .tokens import vocabulary

#: Words whose pieces a worker remembers; beyond it the table starts anew.
MEMO = 400_000
#: Fixed limits per script: least and greatest characters per token, greatest share of byte tokens, least entropy.
BANDS = {
    "latin": (1.3, 7.0, 0.10, 4.0),
    "cyrillic": (1.0, 6.0, 0.30, 4.0),
    "greek": (0.6, 5.0, 0.50, 4.0),
    "cjk": (0.3, 3.0, 0.80, 4.0),
    "other": (0.3, 7.0, 0.90, 3.0),
}
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A band's reach in deviations below and above the median; texts that the group around a group counts as.
BELOW, ABOVE, WEIGHT = 3.5, 4.5, 10
#: Entropy that no text has more of: the bits of a vocabulary of 65,536 tokens.
MOST_ENTROPY = 16.0
#: Groups up to which the bands are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 50_000
#: Least deviation of each measure, so that texts of one kind don't reject each other for a trifle.
LEAST_DEVIATION = {"chars_per_token": 0.02, "byte_share": 0.01, "entropy": 0.05}
#: Quartile to standard deviation of a normal distribution.
_NORMAL = 0.6745

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, chars_per_token double, byte_share double, entropy double"
_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
_MEASURED = SCHEMA + ", lang string"
_ARROW = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in _MEASURED.split(", ")])
#: Columns of the bands' groups, finest first.
_LEVELS = (("script", "lang", "size"), ("script", "lang"), ("script",))

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_BLANKS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])

_PIECES: dict[str, Pieces] = {}


class Pieces:
    """Token ids of single words, remembered; and which ids are bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.is_byte = np.fromiter((self.model.is_byte(i) for i in range(n)), bool, n)
        self.memo: dict[bytes, list[int]] = {}

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in _PIECES:
            _PIECES[path] = cls(path)
        return _PIECES[path]

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        if new := [w for w in dict.fromkeys(words) if w not in memo]:
            memo.update(zip(new, self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1)))
        flat: list[int] = []
        sizes = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            ids = memo[w]
            flat += ids
            sizes[i] = len(ids)
        return np.array(flat, np.int64), sizes


def repeated_words(words: Words, width: int = 3) -> np.ndarray:
    """Per text the words that lie in a window of `width` words found twice or more in it."""
    windows = combine(words.hash, width)
    n = len(windows)
    if not n:
        return np.zeros(words.n, np.int64)
    at = np.flatnonzero(words.doc[:n] == words.doc[width - 1 :])
    order = at[np.lexsort((windows[at], words.doc[at]))]
    same = (windows[order][1:] == windows[order][:-1]) & (words.doc[order][1:] == words.doc[order][:-1])
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    covered = np.zeros(len(words.hash), bool)
    for k in range(width):
        covered[order[again] + k] = True
    return np.bincount(words.doc[covered], minlength=words.n).astype(np.int64)


def duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    found = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            found += line in seen
            seen.add(line)
    return found


def scripts(data: np.ndarray, doc: np.ndarray, n: int) -> list[str]:
    """The commonest script of each text's letters, by the lead bytes of UTF-8."""
    kinds = np.full(256, -1)
    kinds[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0xC3, 0xC9 + 1)]] = 0
    kinds[0xD0 : 0xD3 + 1] = 1
    kinds[0xCD : 0xCF + 1] = 2
    kinds[0xE3 : 0xED + 1] = 3
    kinds[[*range(0xD4, 0xE3), 0xEE, 0xEF, *range(0xF0, 0xF5)]] = 4
    kind = kinds[data]
    some = kind >= 0
    counts = np.bincount(doc[some] * 5 + kind[some], minlength=n * 5).reshape(n, 5)
    return [("latin", "cyrillic", "greek", "cjk", "other")[k] if c[k] else "other" for c, k in zip(counts, counts.argmax(1))]


def measure(texts: list[bytes], pieces: Pieces) -> dict[str, np.ndarray | list]:
    words = Words(texts, lower=False)
    n = len(texts)
    size = np.diff(np.append(words.doc_at, len(words.data))) - 1
    doc = np.repeat(np.arange(n), size + 1)
    point = ((words.data & 0xC0) != 0x80) & ~_BLANKS[words.data]
    out: dict[str, np.ndarray | list] = {"n_words": words.counts(), "word_chars": np.bincount(doc[point], minlength=n).astype(np.int64)}
    out["n_symbols"] = np.bincount(doc, _SYMBOL[words.data], minlength=n).astype(np.int64)
    out["n_dup_lines"] = np.array([duplicate_lines(t.decode("utf-8", "surrogatepass")) for t in texts], np.int64)
    out["n_repeat_words"] = repeated_words(words)
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
    data = words.data.tobytes()
    ids, sizes = pieces.ids([data[a:b] for a, b in zip(words.start.tolist(), words.end.tolist())])
    owner = np.repeat(words.doc, sizes)
    tokens = np.bincount(owner, minlength=n)
    bytes_ = np.bincount(owner[pieces.is_byte[ids]], minlength=n) if len(ids) else np.zeros(n)
    some = np.maximum(tokens, 1)
    out["chars_per_token"], out["byte_share"] = out["word_chars"] / some, bytes_ / some
    pair, count = np.unique(owner * len(pieces.is_byte) + ids, return_counts=True)
    of = pair // len(pieces.is_byte)
    p = count / some[of]
    out["entropy"] = np.bincount(of, -p * np.log2(p), minlength=n) + 0.0
    out["script"] = scripts(words.data, doc, n)
    low, high, most_bytes, least_entropy = (np.array(b) for b in zip(*(BANDS[s] for s in out["script"])))
    inside = (out["chars_per_token"] >= low) & (out["chars_per_token"] <= high) & (out["byte_share"] <= most_bytes) & (out["entropy"] >= least_entropy)
    out["kept"] = ~out["base_failed"] & inside
    return out


def corpus_bands(measured: DataFrame) -> DataFrame:
    """level, script, lang, size, n and per measure its least and greatest value, of every group of texts.

    Values are rounded, so the exact quartiles are taken of counts of few values and don't depend on partitions.
    """
    of = [F.struct(F.lit(i).alias("level"), *(F.col(c) if c in level else F.lit(None).alias(c) for c in _LEVELS[0])) for i, level in enumerate(_LEVELS)]
    rows = measured.where("not base_failed").select(F.explode(F.array(*of)).alias("of"), *LEAST_DEVIATION)
    quartiles = [F.percentile(F.round(m, 3), [0.25, 0.5, 0.75]).alias(m) for m in LEAST_DEVIATION]
    groups = rows.groupBy("of").agg(F.count(F.lit(1)).alias("n"), *quartiles)

    def edge(m: str, reach: float, quarter: int) -> F.Column:
        deviation = F.greatest(F.abs(F.col(m)[quarter] - F.col(m)[1]) / _NORMAL, F.lit(LEAST_DEVIATION[m]))
        return F.col(m)[1] + reach * deviation

    edges = [e for m in LEAST_DEVIATION for e in (edge(m, -BELOW, 0).alias(f"low_{m}"), edge(m, ABOVE, 2).alias(f"high_{m}"))]
    return groups.select("of.*", "n", *edges)


def _fixed(place: int, otherwise: float | None = None) -> F.Column:
    """A script's fixed limit."""
    if otherwise is not None:
        return F.lit(otherwise)
    found = F.lit(None).cast("double")
    for script, limits in BANDS.items():
        found = F.when(F.col("script") == script, F.lit(float(limits[place]))).otherwise(found)
    return found


def keep_inside(measured: DataFrame, bands: DataFrame) -> DataFrame:
    """`kept` also asks for the measures to lie in the band of the text's finest group, as drawn towards its parents'."""
    edges = {"low_chars_per_token": _fixed(0), "high_chars_per_token": _fixed(1), "high_byte_share": _fixed(2), "low_entropy": _fixed(3), "high_entropy": _fixed(3, MOST_ENTROPY)}
    bands = materialize(bands, "bands")
    few = bands.count() <= BROADCAST_GROUPS
    for i, level in reversed(list(enumerate(_LEVELS))):
        near = bands.where(F.col("level") == i).select(*level, F.struct("n", *edges).alias(f"band{i}"))
        measured = measured.join(F.broadcast(near) if few else near, list(level), "left")
        n = F.coalesce(F.col(f"band{i}.n"), F.lit(0))
        edges = {c: (n * F.coalesce(F.col(f"band{i}.{c}"), F.lit(0.0)) + WEIGHT * parent) / (n + WEIGHT) for c, parent in edges.items()}
    inside = (F.col("byte_share") <= edges["high_byte_share"]) & F.col("chars_per_token").between(edges["low_chars_per_token"], edges["high_chars_per_token"]) & F.col("entropy").between(edges["low_entropy"], edges["high_entropy"])
    return measured.withColumn("kept", F.col("kept") & inside)


def apply_rules(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """One row per document: base counts, base_failed, kept, script and the three measures."""
    tune(docs.sparkSession)
    path = vocab or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for batch in batches:
            for first, texts in chunks(batch["text"].to_pylist()):
                got = measure(texts, pieces)
                got["doc_id"], got["lang"] = (batch[c].slice(first, len(texts)) for c in ("doc_id", "lang"))
                yield pa.RecordBatch.from_arrays([c if isinstance(c := got[k], pa.Array) else pa.array(c, t) for k, t in zip(_ARROW.names, _ARROW.types)], schema=_ARROW)

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    measured = materialize(rows.mapInArrow(run, _MEASURED), "fertility").withColumn("size", F.floor(F.log2(F.greatest("n_words", F.lit(1)))))
    return keep_inside(measured, corpus_bands(measured)).select(*_ARROW.names[:-1])
