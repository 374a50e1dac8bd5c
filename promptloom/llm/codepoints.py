"""Words and character n-grams of many texts at once, as numpy arrays of code points."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

STEP = 1 << 20                      # code points worked on at once, beyond a single text's window
_MUL = 0x9E3779B97F4A7C15           # odd, so its powers do not vanish modulo 2**64
_POWERS = 1 << 16                   # letters after which the powers repeat


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter or mark, and its lower case where that is one code point."""
    word = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        if unicodedata.category(ch := chr(cp))[0] in "LM":
            word[cp] = True
            if len(low := ch.lower()) == 1:
                lower[cp] = ord(low)
    return word, lower


@cache
def powers() -> np.ndarray:
    return np.multiply.accumulate(np.full(_POWERS, _MUL, np.uint64))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def groups(texts: Iterable[str | None], step: int = STEP) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in order, gathered to about ``step`` characters: (row numbers, texts).

    A longer text is cut where a word ends and its pieces carry the same row number;
    a word of more than ``step`` letters is cut inside."""
    rows, held, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in cut(text or "", step):
            if held and size + len(piece) > step:
                yield rows, held
                rows, held, size = [], [], 0
            rows.append(i)
            held.append(piece)
            size += len(piece) + 1
    if held:
        yield rows, held


def cut(text: str, step: int = STEP) -> Iterator[str]:
    start = 0
    while len(text) - start > step:
        end = start + step
        while end > start and text[end].isalpha() and text[end - 1].isalpha():
            end -= 1
        end = end if end > start else start + step
        yield text[start:end]
        start = end
    yield text[start:]


class Words:
    """All words (runs of letters and marks, lower-cased) of some texts.

    ``letters``: their code points, one word after the other; ``offset``, ``length``:
    where each word lies there; ``text``: the number of its text."""

    def __init__(self, texts: list[str]):
        is_word, lower = tables()
        a = codes(" ".join(texts) + " ")
        mask = is_word[a]
        edge = np.flatnonzero(np.diff(mask, prepend=False, append=False))
        starts, ends = edge[0::2], edge[1::2]
        self.letters = lower[a[mask]].astype(np.uint64)
        self.length = ends - starts
        self.offset = np.cumsum(self.length) - self.length
        bounds = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(bounds, starts, side="right")
        self.position = np.arange(len(self.letters)) - np.repeat(self.offset, self.length)
        self.n = len(starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not self.n:
            return np.empty(0, np.uint64)
        terms = self.letters * powers()[self.position & (_POWERS - 1)]
        h = np.add.reduceat(terms, self.offset) ^ (self.length.astype(np.uint64) << np.uint64(44))
        return mixed(h)

    def grams(self, n: int, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams inside words, and the number of the word of each.

        ``words``: only of these (a boolean array)."""
        ok = np.repeat(self.length, self.length) - self.position >= n
        if words is not None:
            ok &= np.repeat(words, self.length)
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h += self.letters[at + k] * powers()[k]
        return mixed(h), np.repeat(np.arange(self.n), self.length)[at]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def find(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where each key stands in a sorted table, -1 where it does not."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def sums(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Row sums of ``values`` (m x k) by number ``of``."""
    return np.stack([np.bincount(of, values[:, k], n) for k in range(values.shape[1])], 1) \
        if len(values) else np.zeros((n, values.shape[1]))
