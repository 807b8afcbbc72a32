"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word's hash is a polynomial over its bytes, taken from prefix sums modulo 2**64, so no Python
object is made per word. Callers that need certainty compare the bytes of the few words that matter.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RANDOM = np.random.default_rng(20240131)
_BYTE = _RANDOM.integers(1 << 62, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: After A-Z became lower case: digits, a-z and every byte of a character beyond ASCII.
WORD = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: All but space and the five ASCII controls that are white space.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse to the powers 0..n-1 modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (_BASE, _INVERSE):
            line = np.full(size, base, np.uint64)
            line[0] = 1
            made.append(np.multiply.accumulate(line))
        if size > 1 << 20:  # for one long text: not kept
            return made[0], made[1]
        _powers = (made[0], made[1])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Words of a slice, in order: hash, first byte, byte after the last; first[d] is the number of words before row d."""

    data: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> Words:
    """data: bytes of the rows; offsets: where each row begins, and the end; word: which bytes make words."""
    low = LOWER[data]
    inside = word[low]
    n = len(low)
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    before[begins] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    after[begins[begins > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    power, inverse = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[low] * power[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * inverse[start])
    return Words(low, hashes, start, end, np.searchsorted(start, offsets))


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its runs of `size` words; of the whole sequence where it is shorter; empty without words."""
    h, n = words.hashes, len(words.hashes)
    if n >= size:
        run = h[: n - size + 1].copy()
        for k in range(1, size):
            run *= np.uint64(_BASE)
            run += h[k : n - size + 1 + k]
        run = mix(run)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(run[a : b - size + 1]))
        elif b > a:
            whole = 0
            for x in h[a:b].tolist():
                whole = (whole * _BASE + x + b - a) & 0xFFFFFFFFFFFFFFFF
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
