"""The 64-bit byte hash that names buckets, shapes and namespaces.

Two forms that agree: a Column expression for single values (JVM only), and a numpy kernel that hashes all words of an
arrow batch at once, one byte position at a time, for bulk text.  The JVM has no wrapping multiplication in ANSI mode, so
the expression carries 32-bit halves; the prime is 2**40 + 435.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset basis and prime.
BASIS = 1469598103934665603
PRIME = 1099511628211
_MASK = 0xFFFFFFFF


def fnv_py(data: bytes) -> int:
    h = BASIS
    for b in data:
        h = (h ^ b) * PRIME % 2**64
    return h


def fnv_parts(c: Column) -> Column:
    """struct(hi, lo) of the hash of a string's UTF-8 bytes."""
    digits = F.hex(F.encode(c, "UTF-8"))
    count = F.octet_length(c)
    values = F.when(count == 0, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(1), count), lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))
    )
    start = F.struct(F.lit(BASIS >> 32).cast("long").alias("hi"), F.lit(BASIS & _MASK).cast("long").alias("lo"))

    def step(s: Column, b: Column) -> Column:
        low = s["lo"].bitwiseXOR(b)
        product = low * 435
        high = s["hi"] * 435 + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(F.lit(_MASK).cast("long")).alias("hi"), product.bitwiseAND(F.lit(_MASK).cast("long")).alias("lo"))

    return F.aggregate(values, start, step)


def fnv1a(c: Column) -> Column:
    """The hash as a signed 64-bit number (same bits)."""
    p = fnv_parts(c)
    return F.shiftleft(p["hi"], 32).bitwiseOR(p["lo"])


def namespace(root: Column, prefix: str = "trailhead") -> Column:
    """A key for everything that belongs to one repository: lower-case hex without padding."""
    return F.concat(F.lit(f"/tmp/{prefix}-"), F.lower(F.hex(fnv1a(root))), F.lit(".sock"))


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the runs of ASCII letters and digits in concatenated texts."""
    is_word = np.append(_WORD[data], False)
    before = np.concatenate([[False], is_word[:-1]])
    inner = offsets[:-1]
    before[inner] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.append(is_word[1:], False)
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def fnv_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each range of ``data`` (uint64), longest ranges last to finish."""
    order = np.argsort(starts - ends, kind="stable")
    s, n = starts[order], (ends - starts)[order]
    h = np.full(len(s), BASIS, np.uint64)
    prime = np.uint64(PRIME)
    for j in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -j, "left"))
        h[:live] = (h[:live] ^ data[s[:live] + j].astype(np.uint64)) * prime
    out = np.empty_like(h)
    out[order] = h
    return out


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]
