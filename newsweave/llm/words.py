"""Words of a text as 64-bit hashes, computed over its bytes without a loop over words.

A word is a run of ASCII letters, ASCII digits and non-ASCII characters, A-Z lower-cased.
"""

from __future__ import annotations

import numpy as np

SPACE = 32
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else SPACE
    for b in range(256)
)
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept for the next text."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base & MASK, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: bytes | None) -> np.ndarray:
    """One uint64 for each word, in order; equal words have equal hashes in every process."""
    if not data:
        return np.zeros(0, np.uint64)
    letters = np.frombuffer(data.translate(TABLE), np.uint8)
    inside = np.zeros(len(letters) + 2, np.int8)
    inside[1:-1] = letters != SPACE
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers_to(len(letters) + 1)
    prefix = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(letters * power[:-1], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, k):
        out *= np.uint64(BASE)
        out += words[i : i + n]
    return mix(out + np.uint64(k))
