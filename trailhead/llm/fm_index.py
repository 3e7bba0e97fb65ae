"""Compressed FM-index: Burrows-Wheeler transform in a wavelet tree, backward search for many patterns at once.

The text is a sequence of integers.  The wavelet tree is stored level by level (a wavelet matrix): one bit a symbol and
level, packed in 64-bit words with a running count a word, so that the index has about log2(alphabet) bits a symbol and
a rank is one popcount.  No suffix array is kept: every ``SAMPLE``-th position of the text is, and the others are found by
stepping back through the transform.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 32


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling.  The last symbol must be the smallest and occur once."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 2) + second
        sa = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        k = key[sa]
        new[1:] = k[1:] != k[:-1]
        rank[sa] = np.cumsum(new) - 1
        width *= 2
        if width >= n or new.all():
            return sa


class WaveletTree:
    """Rank of a symbol in a prefix, vectorised over queries."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.words, self.counts, self.zeros = bits, [], [], []
        n = len(symbols)
        cur = symbols
        for level in range(bits - 1, -1, -1):
            bit = (cur >> level & 1).astype(np.uint8)
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))]).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits of a level before ``at``."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before ``at``; base[symbol] is where its run starts on the last level."""
        i = at
        for level in range(self.bits):
            ones = self._ones(level, i)
            bit = (symbol >> (self.bits - 1 - level)) & 1
            i = np.where(bit, self.zeros[level] + ones, i - ones)
        return i - base[symbol]

    def access(self, at: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the symbol at each place, its occurrences before)."""
        i, symbol = at, np.zeros(len(at), np.int64)
        for level in range(self.bits):
            bit = (self.words[level][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self._ones(level, i)
            symbol = symbol << 1 | bit
            i = np.where(bit, self.zeros[level] + ones, i - ones)
        return symbol, i - base[symbol]


class FMIndex:
    def __init__(self, text: np.ndarray):
        """``text``: integers from 0; its last symbol must be the only 0."""
        self.n = len(text)
        sa = suffix_array(text)
        sigma = int(text.max()) + 1
        counts = np.bincount(text, minlength=sigma + 1)
        self.below = np.concatenate([[0], np.cumsum(counts)])  # symbols smaller than s
        bits = max(1, int(sigma - 1).bit_length())
        self.tree = WaveletTree(text[sa - 1], bits)
        order = np.arange(sigma)
        shuffled = np.zeros(sigma, np.int64)
        for b in range(bits):
            shuffled |= (order >> b & 1) << (bits - 1 - b)
        place = np.argsort(shuffled, kind="stable")  # symbols by reversed bits: their order on the last level
        self.base = np.zeros(sigma + 1, np.int64)
        self.base[place] = np.concatenate([[0], np.cumsum(counts[:sigma][place])[:-1]])

        kept = sa % SAMPLE == 0
        self.marked = WaveletTree(kept.astype(np.int64), 1)
        self.samples = sa[kept].astype(np.int32)

    def step(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``symbol`` put in front."""
        c = self.below[symbol]
        return c + self.tree.rank(symbol, lo, self.base), c + self.tree.rank(symbol, hi, self.base)

    def matching(self, text: np.ndarray, ends: np.ndarray, cap: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a streamed text: for each end (exclusive), how many symbols before it, at most ``cap``,
        match at ``least`` places or more, and the interval of these places."""
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        got = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        for k in range(cap):
            symbol = text[ends[live] - 1 - k]
            a, b = self.step(lo[live], hi[live], symbol)
            good = b - a >= least
            live = live[good]
            lo[live], hi[live] = a[good], b[good]
            got[live] = k + 1
            if not len(live):
                break
        return got, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes at these places of the order, by steps back to a sampled one."""
        out, at, live = np.zeros(len(rows), np.int64), rows.astype(np.int64), np.arange(len(rows))
        one = np.zeros(2, np.int64)
        for back in range(SAMPLE):
            if not len(live):
                break
            here = at[live]
            known = self.marked.access(here, one)[0] == 1
            out[live[known]] = self.samples[self.marked._ones(0, here[known])] + back
            live = live[~known]
            symbol, before = self.tree.access(at[live], self.base)
            at[live] = self.below[symbol] + before
        return out
