"""Distinct word shingles of texts as sorted 64-bit hashes.

Letters A-Z are lower-cased; words are runs of anything but blanks and the characters from tab to carriage return. A
text of fewer than five words is one shingle, a text without words has none. Equal hashes count as equal shingles:
with 64 bits, a chance of 1e-11 for a text of twenty thousand.
"""

from __future__ import annotations

import functools

import numpy as np

WORDS = 5
# Odd multipliers, drawn once.
BASE = np.uint64(0x9E3779B97F4A7C15)
STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


@functools.lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    out = []
    for b in (BASE, inverse):
        row = np.full(size, b, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole number."""
    x = (x ^ (x >> np.uint64(30))) * STEPS[0]
    x = (x ^ (x >> np.uint64(27))) * STEPS[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    inside = np.concatenate([[False], ~BLANK[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(1 << max(16, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data] + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str) -> np.ndarray:
    """The distinct shingles of a text, in order of their hashes."""
    words = word_hashes(text)
    if len(words) < WORDS:
        if not len(words):
            return words
        return mix((words * STEPS[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    n = len(words) - WORDS + 1
    out = words[:n] * STEPS[0]
    for j in range(1, WORDS):
        out = out + words[j : j + n] * STEPS[j]
    return np.unique(mix(out))
