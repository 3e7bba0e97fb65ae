"""The perfect binary Golay code (23, 12, 7): every 23-bit word lies within distance 3 of exactly one codeword.

Words one bit apart share a codeword unless both lie at distance 3 from theirs; then each is at distance 4 from the
other's.  So the codewords within distance 4 of x hold the codeword of every y within one bit of x.  A word at distance
3 or more has six of them, any other one.  Tables are built from the generator polynomial, not stored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _syndrome_of(word: int) -> int:
    for b in range(22, 10, -1):
        if word >> b & 1:
            word ^= GENERATOR << (b - 11)
    return word


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes of single bits, error pattern by syndrome, the 253 codewords of weight 7)."""
    single = np.array([_syndrome_of(1 << b) for b in range(23)], np.int64)
    error = np.zeros(2048, np.int64)
    for r in (1, 2, 3):
        for c in combinations(range(23), r):
            s = 0
            for b in c:
                s ^= int(single[b])
            error[s] = sum(1 << b for b in c)
    words = np.zeros(4096, np.int64)
    for i in range(12):
        row = (1 << (i + 11)) | int(single[i + 11])
        words = np.where(np.arange(4096) >> i & 1, words ^ row, words)
    return single, error, words[np.bitwise_count(words) == 7]


def syndromes(x: np.ndarray) -> np.ndarray:
    single = _tables()[0]
    s = np.zeros(len(x), np.int64)
    for b in range(23):
        s ^= np.where(x >> b & 1, single[b], 0)
    return s


def decode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest codeword: its 12 data bits, the error pattern) of 23-bit words."""
    e = _tables()[1][syndromes(x)]
    return (x ^ e) >> 11, e


@lru_cache(1)
def _through() -> dict[int, list[int]]:
    """For each 3-bit error pattern the five weight-7 codewords that contain it."""
    out: dict[int, list[int]] = {}
    for w in map(int, _tables()[2]):
        bits = [b for b in range(23) if w >> b & 1]
        for c in combinations(bits, 3):
            out.setdefault(sum(1 << b for b in c), []).append(w)
    return out


@lru_cache(1)
def _extra() -> np.ndarray:
    """By syndrome: six shifts of the nearest codeword's index; -1 where there is none."""
    _, error, _ = _tables()
    table = np.full((2048, 6), -1, np.int64)
    table[:, 0] = 0
    for s, e in enumerate(error):
        if int(e).bit_count() == 3:
            table[s, 1:] = [w >> 11 for w in _through()[int(e)]]
    return table


def nearby(x: np.ndarray) -> np.ndarray:
    """(n, 6) indices of all codewords within distance 4, -1 where fewer; column 0 is the nearest."""
    s = syndromes(x)
    home = (x ^ _tables()[1][s]) >> 11
    t = _extra()[s]
    return np.where(t >= 0, home[:, None] ^ t, -1)


@lru_cache(1)
def _by_halves() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes of the low 12 bits, of the high 11, the codewords' signs): tables for many words at once."""
    low, high = syndromes(np.arange(1 << 12)), syndromes(np.arange(1 << 11) << 12)
    single = _tables()[0]
    words = np.zeros(4096, np.int64)
    for i in range(12):
        words ^= np.where(np.arange(4096) >> i & 1, (1 << (i + 11)) | int(single[i + 11]), 0)
    return low, high, (2 * (words[:, None] >> np.arange(23) & 1) - 1).astype(np.float32)


def nearest(x: np.ndarray, m: int, unsure: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(indices, scores), each (n, m): the codewords found that agree best with real values x of shape (n, 23).

    The signs of x are decoded with every combination of the ``unsure`` least certain ones flipped; the codewords so met
    are ranked by the sum of x over their signs (ties: the smaller index).  -1 and -inf where fewer are met.
    """
    _, error, _ = _tables()
    low, high, signs = _by_halves()
    n = len(x)
    word = (x > 0) @ (1 << np.arange(23))
    weak = 1 << np.argsort(np.abs(x), axis=1, kind="stable")[:, :unsure]
    flips = np.zeros((n, 1), np.int64)
    for i in range(unsure):
        flips = np.concatenate([flips, flips ^ weak[:, i : i + 1]], axis=1)
    y = word[:, None] ^ flips
    index = np.sort((y ^ error[low[y & 4095] ^ high[y >> 12]]) >> 11, axis=1)
    score = np.matmul(signs[index], x[:, :, None].astype(np.float32))[:, :, 0]
    score[:, 1:][index[:, 1:] == index[:, :-1]] = -np.inf
    best = np.argsort(-score, axis=1, kind="stable")[:, :m]
    index, score = np.take_along_axis(index, best, 1), np.take_along_axis(score, best, 1)
    return np.where(np.isfinite(score), index, -1), score
