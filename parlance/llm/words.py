"""Words and word hashes of many texts at once, on UTF-8 bytes.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. Its hash ignores the case of A-Z. All arrays of one
slice are bounded by the slice's bytes; a single text above the bound makes a slice of its own."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .common import strings

U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes (the public splitmix64 steps)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _letters() -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=U) * U(_MULT))
    t[65:91] = t[97:123]
    return t


LETTER_HASH = _letters()
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        n = max(n, 1 << 16)
        for name, m in (("up", _MULT), ("down", _INV)):
            p = np.full(n, m, U)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=U)
    return _powers["up"], _powers["down"]


class Prefix:
    """Hashes of any stretch of a sequence in constant time, by differences of prefix sums."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


class Words(NamedTuple):
    first: int  # the slice's first row in the batch
    data: np.ndarray  # its bytes
    text: np.ndarray  # n+1 byte offsets of its texts
    start: np.ndarray  # byte offsets of words
    end: np.ndarray
    hash: np.ndarray
    of: np.ndarray  # n+1 word offsets of its texts


def scan(data: np.ndarray, text: np.ndarray, first: int = 0, hashes: bool = True) -> Words:
    black = ~WHITE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[text] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    if len(data):
        before[1:] = black[:-1]
        before &= ~cut[:-1]
        after[:-1] = black[1:]
        after &= ~cut[1:]
    start, end = np.flatnonzero(black & ~before), np.flatnonzero(black & ~after) + 1
    h = Prefix(LETTER_HASH[data])(start, end) if hashes else np.zeros(0, U)
    return Words(first, data, text, start, end, h, np.searchsorted(start, text))


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of about `limit` bytes together."""
    data, off = strings(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words, in order, and their n+1 offsets. A text of fewer words (but not none) has
    all its words as its one shingle."""
    many = np.diff(words.of)
    count = np.where(many >= k, many - k + 1, (many > 0).astype(many.dtype))
    off = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(many)), count)
    start = words.of[row] + (np.arange(off[-1]) - off[row])
    return Prefix(words.hash)(start, np.minimum(start + k, words.of[row + 1])), off


EDGE = np.zeros(256, bool)
EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def bare(w: Words, *stems: int) -> np.ndarray | list[np.ndarray]:
    """Hashes of the words without ASCII punctuation at their ends; 0 for words of nothing else. With stems also, for each
    of these lengths, hashes of the words' first so many bytes; 0 for words that are no longer."""
    start, end = w.start.copy(), w.end.copy()
    for place, step in ((start, 1), (end, -1)):
        at = np.arange(len(start))
        while len(at):
            at = at[end[at] > start[at]]
            at = at[EDGE[w.data[place[at] + min(step, 0)]]]
            place[at] += step
    hashes = Prefix(LETTER_HASH[w.data])
    h = hashes(start, end)
    h[end <= start] = 0
    if not stems:
        return h
    return [h, *(np.where(end - start > n, hashes(start, np.minimum(start + n, end)), U(0)) for n in stems)]


def paragraphs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end words of each line that has words, and the n+1 paragraph offsets of the texts."""
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(w.of), np.int64)
    lines = np.concatenate([[0], np.cumsum(w.data == 10)])
    stop = np.zeros(len(w.start), bool)
    stop[:-1] = lines[w.start[1:]] > lines[w.end[:-1]]
    stop[w.of[1:][np.diff(w.of) > 0] - 1] = True
    last = np.flatnonzero(stop) + 1
    first = np.concatenate([[0], last[:-1]])
    return first, last, np.searchsorted(first, w.of)
