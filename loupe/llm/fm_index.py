"""A compressed full-text index: Burrows-Wheeler transform in a wavelet matrix, with ranks on packed bits.

All queries work on many positions at once (numpy), as backward search of many patterns in step.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of an array of small integers in order, by prefix doubling."""
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    # a sorted key carries its place in its lowest bits, where all fits into 63 bits: sorting is faster than sorting places by key
    place = n.bit_length()
    carried = 3 * place <= 63
    index = np.arange(n)
    width = max(1, int(text.max()).bit_length())
    # the first sorting takes as many symbols at once as there is room for
    k = max(1, ((63 - place) if carried else 62) // width)
    padded = np.r_[text.astype(np.int64), np.zeros(k, np.int64)]
    key = np.zeros(n, np.int64)
    for j in range(k):
        key = (key << width) | padded[j : j + n]
    while True:
        if carried:
            packed = np.sort((key << place) | index)
            order, sorted_key = packed & ((1 << place) - 1), packed >> place
        else:
            order = np.argsort(key)
            sorted_key = key[order]
        fresh = np.r_[0, np.cumsum(sorted_key[1:] != sorted_key[:-1])]
        if fresh[-1] == n - 1 or k >= n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        second = np.zeros(n, np.int64)
        second[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + 1) + second if not carried else (rank << place) | second
        k *= 2


#: The lowest 0 to 63 bits of a word.
_LOWEST = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A packed sequence of bits with ranks."""

    def __init__(self, bits: np.ndarray):
        self.words = np.packbits(np.r_[bits.astype(np.uint8), np.zeros((-len(bits)) % 64 + 64, np.uint8)], bitorder="little").view(np.uint64)
        self.sums = np.r_[0, np.cumsum(np.bitwise_count(self.words).astype(np.int64))].astype(np.int32 if len(bits) < 2**31 else np.int64)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many of the first at[i] bits are set."""
        word = at >> 6
        # take() and a table of masks: few passes over arrays that are short but many
        inside = self.words.take(word)
        inside &= _LOWEST.take(at & 63)
        return self.sums.take(word) + np.bitwise_count(inside)


class WaveletMatrix:
    """Ranks of a symbol in a prefix of a sequence of symbols below 2 ** levels."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.levels = len(symbols), levels
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        s = symbols.astype(np.int64)
        for level in range(levels - 1, -1, -1):
            b = ((s >> level) & 1).astype(bool)
            self.bits.append(Bits(b))
            self.zeros.append(int(len(b) - b.sum()))
            s = np.concatenate([s[~b], s[b]])
        # where each symbol's places begin below the last level
        every = np.arange(1 << levels)
        self.begin = self._down(every, np.zeros(len(every), np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i in range(self.levels):
            ones = self.bits[i].ones(at)
            at = np.where(symbol & (1 << (self.levels - 1 - i)), self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] occurs before position at[i]."""
        return self._down(symbol, at.astype(np.int64)) - self.begin[symbol]


class ShapedWavelet:
    """A wavelet tree with short codes for frequent symbols: the rest have one code in the first matrix, and a matrix of their own."""

    def __init__(self, symbols: np.ndarray, alphabet: int, levels: int = 6):
        counts = np.bincount(symbols, minlength=alphabet + 1)
        frequent = np.argsort(-counts, kind="stable")[: (1 << levels) - 1]
        self.escape = (1 << levels) - 1
        self.code = np.full(len(counts), self.escape)
        self.code[frequent] = np.arange(len(frequent))
        coded = self.code[symbols]
        self.first = WaveletMatrix(coded, levels)
        rest = symbols[coded == self.escape]
        self.second = WaveletMatrix(rest, max(1, int(alphabet).bit_length())) if len(rest) else None

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] occurs before position at[i]."""
        code = self.code[symbol]
        out = self.first.rank(code, at)
        if self.second is not None:
            rare = np.flatnonzero(code == self.escape)
            if len(rare):
                out[rare] = self.second.rank(symbol[rare], out[rare])
        return out


class FMIndex:
    """Index of a sequence of symbols >= 1; 0 is the end. `suffix` is there until compress() drops it."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        text = np.r_[symbols, 0].astype(np.int64)
        self.alphabet = alphabet
        sa = suffix_array(text)
        self.suffix: np.ndarray | None = sa
        self.n = len(text)
        self.wave = ShapedWavelet(text[sa - 1], alphabet)
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=alphabet + 1))][: alphabet + 1]

    def compress(self) -> None:
        """Keep the transform alone: about a bit and a half for each level of the wavelet matrix and symbol."""
        self.suffix = None

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges after putting symbol[i] before the pattern of range [lo[i], hi[i])."""
        start = self.first[symbol]
        both = self.wave.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return start + both[: len(lo)], start + both[len(lo) :]
