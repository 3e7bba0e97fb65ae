"""Vectorised 64-bit hashes of words, n-grams and byte strings (arithmetic modulo 2**64)."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_GRAM = U(0xD6E8FEB86659FD93)
_pow = np.ones(1, U)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection with good avalanche (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + U((seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        _pow = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(max(n, 256) - 1, _BASE)]))
    return _pow[:n]


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def class_table(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


#: Bytes that are no ASCII white space; bytes of [0-9A-Za-z] and of non-ASCII characters.
NOT_SPACE = class_table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALNUM = class_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = lower_table()


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of words; first[d]:first[d+1] are document d's words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    w = table[data]
    edge = w.copy()
    edge[1:] &= ~w[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    edge[inner] = w[inner]
    starts = np.flatnonzero(edge)
    stop = np.empty(len(w), bool)
    stop[:-1] = w[:-1] & ~w[1:]
    stop[-1] = w[-1]
    stop[inner - 1] = w[inner - 1]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Hash of each byte range (ranges ascending, none empty), in blocks of bounded memory."""
    out = np.empty(len(starts), U)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + step, "right")))
        s, e = starts[a:b], ends[a:b]
        lens = e - s
        at = np.concatenate([[0], np.cumsum(lens)])
        within = np.arange(at[-1]) - np.repeat(at[:-1], lens)
        p = powers(int(lens.max()))
        vals = (data[within + np.repeat(s, lens)].astype(U) + U(1)) * p[within]
        out[a:b] = np.add.reduceat(vals, at[:-1])
        a = b
    return mix(out)


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive units, by doubling; length len(x) - n + 1 (or 0)."""
    if len(x) < n:
        return np.zeros(0, U)
    acc, have, cur, width = None, 0, x, 1
    g = int(_GRAM)
    left = n
    while left:
        if left & 1:
            if acc is None:
                acc, have = cur, width
            else:
                m = len(x) - have - width + 1
                acc = acc[:m] + cur[have : have + m] * U(pow(g, have, 2**64))
                have += width
        left >>= 1
        if left:
            m = len(cur) - width
            cur = cur[:m] + cur[width : width + m] * U(pow(g, width, 2**64))
            width *= 2
    return mix(acc, n)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum over each w consecutive values."""
    if len(x) < w:
        return np.zeros(0, x.dtype)
    width, cur = 1, x
    while width * 2 <= w:
        cur = np.minimum(cur[: len(cur) - width], cur[width:])
        width *= 2
    if width < w:
        cur = np.minimum(cur[: len(x) - w + 1], cur[w - width : w - width + len(x) - w + 1])
    return cur
