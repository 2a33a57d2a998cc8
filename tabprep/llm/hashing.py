"""Hashes of words and word windows over whole Arrow batches, without a loop over words."""

from __future__ import annotations

import numpy as np

from tabprep.llm.arrow import ranges

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: ASCII white space, and A-Z in lower case.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    """0th to (n-1)th power of the odd multiplier, modulo 2^64."""
    out = np.full(max(n, 1), _MULTIPLIER, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, A-Z in lower case, and the number of words of each text.

    A word's hash is the sum of table values times powers by place in the word, taken from running sums over a stretch.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SPACE[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    borders = offsets[(offsets > 0) & (offsets < n)]
    opens[borders] = inside[borders]
    closes = np.empty(n, bool)  # the last byte of a word
    closes[-1] = inside[-1]
    closes[:-1] = inside[:-1] & (~inside[1:] | opens[1:])
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    lengths = last - first + 1
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    place = ranges(lengths)
    value = _WORD_TABLE[_LOWER[raw[inside]]]
    value *= powers(int(lengths.max()))[place]
    starts = np.cumsum(lengths) - lengths
    hashes = np.add.reduceat(value, starts)
    counts = np.diff(np.searchsorted(first, offsets))
    return mix(hashes ^ mix(lengths.astype(np.uint64))), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all windows of ``width`` words of each text in order, and their numbers.

    A text with fewer words has its whole sequence as its only shingle; one without words has none.
    """
    each = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    text = np.repeat(np.arange(len(counts)), each)
    first = (np.cumsum(counts) - counts)[text] + ranges(each)
    size = np.minimum(counts, width)[text]
    out = mix(size.astype(np.uint64))
    for k in range(width):
        there = size > k
        if there.all():
            out = mix(out * np.uint64(3) + words[first + k])
        else:
            out[there] = mix(out[there] * np.uint64(3) + words[first[there] + k])
    return out, each


def distinct_by_text(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text, ascending and without repeats, and their numbers."""
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(text[order], kind="stable")]
    text, hashes = text[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.bincount(text[new], minlength=len(counts)).astype(np.int64)
