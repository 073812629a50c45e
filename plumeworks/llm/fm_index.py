"""An FM-index over integer sequences: backward search by ranks in a wavelet matrix."""

from __future__ import annotations

import numpy as np


class BitRank:
    """Packed bits with counts before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:], dtype=np.uint32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Ranks of symbols 0 ... sigma - 1 in a sequence, in one bit a symbol and level."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.levels = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bits = ((sequence >> shift) & 1).astype(bool)
            rank = BitRank(bits)
            self.levels.append((shift, rank, int(len(bits) - bits.sum())))
            sequence = np.concatenate([sequence[~bits], sequence[bits]])
        self.starts = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, rank, zeros in self.levels:
            ones = rank.ones(at).astype(np.int64)
            at = np.where((symbols >> shift) & 1, zeros + ones, at - ones)
        return at

    def ranks(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        return self._down(symbols, at) - self.starts[symbols]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` symbols at least, by prefix doubling."""
    rank, n, h = text.astype(np.int64), len(text), 1
    while True:
        if h >= depth:
            return np.argsort(rank, kind="stable")
        nxt = np.zeros(n, np.int64)
        nxt[: n - h] = rank[h:] + 1
        key = rank * (n + 2) + nxt
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        new[order] = np.r_[0, (np.diff(key[order]) != 0).cumsum()]
        rank, h = new, 2 * h


class FMIndex:
    """Index of a text of symbols 0 ... sigma - 1 for patterns of `depth` symbols at most."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        self.order = suffix_order(text, depth)
        self.first = np.r_[0, np.bincount(text, minlength=sigma).cumsum()]
        self.bwt = WaveletMatrix(text[self.order - 1], sigma)

    def intervals(self, text: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics up to `depth` symbols, read backward from each end: interval of suffixes and length matched.

        A search stops where one suffix is left, which then is the only place of any longer match.
        """
        symbols = text[ends]
        lo, hi = self.first[symbols], self.first[symbols + 1]
        length = (hi > lo).astype(np.int64)
        going = np.flatnonzero(hi - lo > 1)
        for step in range(1, depth):
            if not len(going):
                break
            symbols = text[ends[going] - step]
            a = self.first[symbols] + self.bwt.ranks(symbols, lo[going])
            b = self.first[symbols] + self.bwt.ranks(symbols, hi[going])
            found = b > a
            going, a, b = going[found], a[found], b[found]
            lo[going], hi[going], length[going] = a, b, step + 1
            going = going[b - a > 1]
        return lo, hi, length
