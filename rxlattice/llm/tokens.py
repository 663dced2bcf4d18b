"""Exact token ids of whole texts with the tokenizers library, and crc32 of ids.

The vocabulary's rules never reach across ASCII blanks, so a text's ids are its words' ids in a row. The
words of a batch are told apart by their 64-bit hashes; each distinct one is encoded once per worker and
remembered in a bounded table, and the ids of all occurrences are then gathered by numpy.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np

from .text import Words, chunks

END_ID = 2
#: Words that a worker remembers; beyond it the table starts anew.
MEMO = 600_000

#: Letters of ASCII and Latin-1, then ASCII marks but apostrophes: the vocabulary's rules split them just so.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


_LETTERS = _byte_letters()


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.memo, self.marks = memo, {}, {"": b""}
        self.ids = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def _model(self, text: str) -> bytes:
        """Ids of lower-case letters, or of a run of ASCII marks, straight from the model."""
        if not text.isascii():
            text = "".join([_LETTERS[b] for b in text.encode()])
        return b"".join([self.ids[t.id] for t in self.tokenizer.model.tokenize(text)])

    def _learn(self, keys: list[int], words: list[str]) -> None:
        rest, memo, ids, tokenize = [], self.memo, self.ids, self.tokenizer.model.tokenize
        for key, word in zip(keys, words):
            if word.isascii() and word.isalpha():
                memo[key] = b"".join([ids[t.id] for t in tokenize(word.lower())])
            elif m := _PLAIN.fullmatch(word):
                letters, marks = m.groups()
                if marks not in self.marks:
                    self.marks[marks] = self._model(marks)
                memo[key] = self._model(letters.lower()) + self.marks[marks]
            else:
                rest.append((key, word))
        if rest:
            found = self.tokenizer.encode_batch_fast([w for _, w in rest], add_special_tokens=False)
            memo.update((k, np.array(e.ids, "<u4").tobytes()) for (k, _), e in zip(rest, found))

    def encode(self, texts: Sequence[str | None], end: int | None = None) -> Iterator[np.ndarray]:
        """uint32 ids of each text, followed by `end` if that is given."""
        for _, part in chunks(texts):
            ids, lengths = self.encode_chunk(part, end)
            yield from np.split(ids, np.cumsum(lengths)[:-1])

    def encode_chunk(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        # The vocabulary is in lower case; only its special tokens, which have "<|", tell the cases apart.
        words = Words(texts, lower=not any(b"<|" in t for t in texts), marks=True)
        keys, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.memo) > self.limit or len(self.marks) > self.limit // 10:
            self.memo.clear()
            self.marks = {"": b""}
        known, memo = keys.tolist(), self.memo
        if new := [i for i, k in enumerate(known) if k not in memo]:
            data = words.data
            spans = zip(words.start[first[new]].tolist(), words.end[first[new]].tolist())
            self._learn([known[i] for i in new], [data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in spans])
        found = [memo[k] for k in known]
        if end is not None:  # one more word, at the end of each text
            found.append(self.ids[end])
            at = np.searchsorted(words.doc, np.arange(len(texts)), side="right")
            back = np.insert(back, at, len(known))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        size = sizes[back]
        stop = np.cumsum(size)
        take = np.repeat((np.cumsum(sizes) - sizes)[back] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
        per = words.counts() + (end is not None)
        ends = np.concatenate(([0], stop))[np.cumsum(per)]
        return flat[take], np.diff(ends, prepend=0)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc32(ids: np.ndarray, start: int = 0) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes(), start)
