"""Token ids of whole texts, by a public tokenizer, with a bounded cache of words.

The tokenizer here drops white space, so the ids of a text are those of its
words one after the other. Words are cut at the six ASCII white-space bytes
only; any other white space stays inside a "word" and is left to the tokenizer.

A Python worker encodes a word once and looks it up afterwards. Most new words
are letters with punctuation behind them: their two parts are looked up, or
given to the tokenizer's model as its pre-tokenizer would. All other words, and
all with characters beyond the Latin letters, take the whole tokenizer.
"""

from __future__ import annotations

import os
import string
from itertools import chain

import numpy as np

#: Words a worker remembers; beyond it the first half stays, which holds the frequent ones.
CACHE_WORDS = 500_000
#: First character that the short way leaves to the tokenizer, and the one letter before it
#: that changes its length in lower case.
BEYOND_LATIN, DOTTED_I = "\u0250", "\u0130"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(0x100)}


class _Numbered(dict):
    """Numbers each new word and keeps it for encoding."""

    def __init__(self, words=()):
        super().__init__((w, n) for n, w in enumerate(words))
        self.new = []

    def __missing__(self, word):
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes lists of texts (bytes) to ids, by words."""

    def __init__(self, vocabulary: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.cache_words = cache_words
        self.words, self.parts = _Numbered(), {}
        self.ids = np.empty(0, np.uint32)
        self.counts = np.empty(0, np.int64)
        self.starts = np.empty(0, np.int64)

    def _forget(self):
        keep = self.cache_words // 2
        self.words = _Numbered(w for w, _ in zip(self.words, range(keep)))
        self.parts.clear()
        self.counts, self.starts = self.counts[:keep], self.starts[:keep]
        self.ids = self.ids[: int(self.counts.sum())]

    def _part(self, part: str) -> list[int]:
        known = self.parts.get(part)
        if known is None:
            spelt = part if part.isascii() else (
                part.encode().decode("latin-1").translate(self.letters)
            )
            known = self.parts[part] = [t.id for t in self.model.tokenize(spelt)]
        return known

    def _word(self, word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        low = text.lower()
        core = low.rstrip(string.punctuation)
        if core.isalpha() and (core.isascii() or (max(core) < BEYOND_LATIN and DOTTED_I not in text)):
            tail = low[len(core) :]
            return self._part(core) + self._part(tail) if tail else self._part(core)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self):
        new, self.words.new = self.words.new, []
        if len(self.parts) > self.cache_words:
            self.parts.clear()
        if new:
            found = list(map(self._word, new))
            counts = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
            self.ids = np.concatenate([self.ids, ids])
            self.counts = np.concatenate([self.counts, counts])
            self.starts = np.cumsum(self.counts) - self.counts

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each."""
        if len(self.words) > self.cache_words:
            self._forget()
        words = [t.split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        index = np.fromiter(
            map(self.words.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum())
        )
        self._learn()
        n = self.counts[index]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[index] - (ends - n), n)
        at += np.arange(len(at))
        cuts = np.append(0, ends)[np.append(0, np.cumsum(sizes))]
        return self.ids[at], np.diff(cuts)


def worker_encoder(vocabulary: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """The encoder of this Python worker, which keeps its words from task to task, *cache_words*
    at most (some 600 bytes each).

    Functions reach the workers by value, so a variable of this module would be
    a new one in each task; the tokenizer library's module is not.
    """
    import tokenizers

    held = vars(tokenizers).setdefault("_worker_encoders", {})
    if (vocabulary, cache_words) not in held:
        held[vocabulary, cache_words] = Encoder(vocabulary, cache_words)
    return held[vocabulary, cache_words]


def batches(texts: list[bytes], limit: int = 4 << 20):
    """(first, last + 1) of runs of texts of about *limit* bytes."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def as_bytes(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null gives empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
