"""Rising sequences in Elias-Fano form, and a trie of number tuples whose levels they are.

A sequence of n numbers below u takes about 2 + log2(u/n) bits a number: the low bits are
packed, the high bits are written in unary.  Reading works on whole arrays of places.
"""

from __future__ import annotations

import mmap

import numpy as np

PART = 1 << 14
_IN_BYTE = np.zeros((256, 8), np.uint8)  # place of the k-th set bit of a byte
for _b in range(256):
    for _k, _place in enumerate(p for p in range(8) if _b >> p & 1):
        _IN_BYTE[_b, _k] = _place


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit; ``before[i]`` counts set bits up to word i, included."""
    at = np.searchsorted(before, k, "right")
    word = words[at]
    k = (k - before[at] + np.bitwise_count(word)).astype(np.uint8)  # rank inside the word
    place = at << 6
    for width in (32, 16, 8):  # go to the half that holds it
        half = word & np.uint64((1 << width) - 1)
        count = np.bitwise_count(half)
        upper = k >= count
        k -= count * upper
        word = np.where(upper, word >> np.uint64(width), half)
        place += upper * np.int64(width)
    return place + _IN_BYTE[word.astype(np.uint8), k]


class EliasFano:
    """A strictly or weakly rising sequence of numbers that aren't negative, over one buffer."""

    HEAD = 4  # int64: numbers, low bits, words of low bits, words of high bits

    def __init__(self, buffer: memoryview, start: int = 0):
        self.n, self.low, lows, highs = np.frombuffer(buffer, np.int64, self.HEAD, start).tolist()
        start += 8 * self.HEAD
        self.lows = np.frombuffer(buffer, np.uint64, lows, start)
        self.highs = np.frombuffer(buffer, np.uint64, highs, start + 8 * lows)
        self.end = start + 8 * (lows + highs)
        ones = np.bitwise_count(self.highs).astype(np.int64)
        self.ones, self.zeros = np.cumsum(ones), np.cumsum(64 - ones)
        self.inverse = ~self.highs

    @classmethod
    def packed(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n, most = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (most // max(n, 1)).bit_length() - 1)
        lows = np.zeros(n * low // 64 + 2, np.uint64)
        if low:
            part = values & np.uint64((1 << low) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(low)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(lows, word, part << bit)
            over = bit + np.uint64(low) > 64
            np.bitwise_or.at(lows, word[over] + 1, part[over] >> (np.uint64(64) - bit[over]))
        place = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        # a zero closes each high part, up to one behind the last
        size = (most >> low) + n + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[place] = 1
        highs = np.packbits(bits, bitorder="little").view(np.uint64)
        head = np.array([n, low, len(lows), len(highs)], np.int64)
        return head.tobytes() + lows.tobytes() + highs.tobytes()

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(at), np.int64)
        at = at.astype(np.uint64) * np.uint64(self.low)
        word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        part = self.lows[word] >> bit
        over = bit > 0
        part[over] |= self.lows[word[over] + 1] << (np.uint64(64) - bit[over])
        return (part & np.uint64((1 << self.low) - 1)).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The numbers at these places."""
        if not len(at):
            return np.zeros(0, np.int64)
        return ((_select(self.highs, self.ones, at) - at) << self.low) | self._low(at)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first number not below x, ``n`` where there is none."""
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64)
        high = x >> self.low
        last = int(self.zeros[-1]) - 1

        def starts(h: np.ndarray) -> np.ndarray:
            """Numbers with a high part below h."""
            out = np.zeros(len(h), np.int64)
            inside = (h > 0) & (h <= last)
            out[inside] = _select(self.inverse, self.zeros, h[inside] - 1) - (h[inside] - 1)
            out[h > last] = self.n
            return np.minimum(out, self.n)

        start, end = starts(high), starts(high + 1)
        part = x & ((1 << self.low) - 1)
        while True:  # halve the part of equal high bits, all places at once
            open_ = np.flatnonzero(start < end)
            if not len(open_):
                return start
            middle = (start[open_] + end[open_]) // 2
            less = self._low(middle) < part[open_]
            start[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]


def _relative(context: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Ids of one context after the other as one rising sequence: each starts behind the last one's largest."""
    last = np.flatnonzero(np.r_[context[1:] != context[:-1], True]) if len(ids) else np.zeros(0, np.int64)
    base = np.cumsum(np.r_[0, ids[last] + 1])[:-1]
    return ids + base[context]


class Trie:
    """Tuples (a, b, c): sequences of ids, and of pointers to the next level, in one memory map.

    The children of a node hold ids relative to the context: behind the largest id of the
    node before.  Looking one up is a successor search for the base of the context plus id.
    """

    LEVELS = 5

    def __init__(self, buffer: memoryview):
        sizes = np.frombuffer(buffer, np.int64, self.LEVELS)
        starts = np.cumsum(np.r_[8 * self.LEVELS, sizes])
        self.first, self.to_second, self.second, self.to_third, self.third = (
            EliasFano(buffer, int(s)) for s in starts[:-1]
        )
        self.size = int(starts[-1])

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> Trie:
        """Of distinct tuples, sorted."""
        new_a = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
        new_b = new_a | np.r_[True, b[1:] != b[:-1]] if len(a) else new_a
        pair = np.cumsum(new_b) - 1  # of each tuple
        top = (np.cumsum(new_a) - 1)[new_b]  # of each pair
        levels = [
            a[new_a],
            np.searchsorted(top, np.arange(new_a.sum() + 1)),
            _relative(top, b[new_b]),
            np.searchsorted(pair, np.arange(new_b.sum() + 1)),
            _relative(pair, c),
        ]
        packed = [EliasFano.packed(level) for level in levels]
        data = np.array([len(p) for p in packed], np.int64).tobytes() + b"".join(packed)
        buffer = mmap.mmap(-1, len(data))
        buffer.write(data)
        return cls(memoryview(buffer).toreadonly())

    @staticmethod
    def _child(pointers: EliasFano, level: EliasFano, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """``_children``, in parts that stay in the processor's cache."""
        parts = [slice(i, i + PART) for i in range(0, len(ids), PART)]
        return np.concatenate([np.zeros(0, np.int64), *(Trie._children(pointers, level, context[p], ids[p]) for p in parts)])

    @staticmethod
    def _children(pointers: EliasFano, level: EliasFano, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Place of each id among the children of its context; -1 where it isn't (or the context is -1)."""
        out = np.full(len(ids), -1, np.int64)
        inside = np.flatnonzero(context >= 0)
        start, end = pointers.get(context[inside]), pointers.get(context[inside] + 1)
        base = np.where(start > 0, level.get(np.maximum(start - 1, 0)) + 1, 0) if len(inside) else start
        wanted = base + ids[inside]
        at = level.successor(wanted)
        hit = np.flatnonzero(at < end)
        hit = hit[level.get(at[hit]) == wanted[hit]]
        out[inside[hit]] = at[hit]
        return out

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of pairs in the second level, -1 for others."""
        at = self.first.successor(a)
        there = at < self.first.n
        there[there] = self.first.get(at[there]) == a[there]
        return self._child(self.to_second, self.second, np.where(there, at, -1), b)

    def tuples(self, pair: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Places of the pair's children in the third level, -1 for others."""
        return self._child(self.to_third, self.third, pair, c)
