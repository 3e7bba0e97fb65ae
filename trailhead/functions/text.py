"""Tokens, the hashing embedder and structural fingerprints."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema, session
from . import hashing

#: Words that the embedder leaves out.
STOP_WORDS = [
    "the", "is", "in", "at", "which", "on", "for", "a", "an", "this", "that",
    "to", "and", "or", "what", "how", "why", "who", "when", "where", "are",
    "of", "it", "with", "as", "by", "from", "used", "project", "codebase", "repo",
]


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased (everything else separates)."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9]+)"), F.lit(1)), lambda t: F.lower(t))


def content_tokens(text: Column) -> Column:
    """Tokens without stop words."""
    return F.filter(tokens(text), lambda t: ~t.isin(STOP_WORDS))


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = col.cast(pa.large_string())
    col = col.fill_null("") if col.null_count else col
    n = len(col)
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64, n + 1 + col.offset)[col.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return hashing.lower(raw[o[0] : o[-1]]), o - o[0]


_STOP = None


def _stop_hashes() -> np.ndarray:
    global _STOP
    if _STOP is None:
        _STOP = np.sort(np.array([hashing.fnv_py(w.encode()) for w in STOP_WORDS], np.uint64))
    return _STOP


def _word_hashes(col: pa.Array, drop_stop: bool) -> tuple[np.ndarray, np.ndarray]:
    data, off = _flat(col)
    row, s, e = hashing.words(data, off)
    h = hashing.fnv_words(data, s, e)
    if drop_stop:
        keep = ~np.isin(h, _stop_hashes())
        row, h = row[keep], h[keep]
    return row, h


#: Bytes of text that a kernel takes at once; its arrays are some dozens of times as large.
PIECE = 1 << 20


def pieces(b: pa.RecordBatch, col: str, size: int = PIECE):
    """``b`` in slices of at most ``size`` bytes of ``col``, or of one row: a batch has many rows, however long they are."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield b.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def _mapped(df: DataFrame, text_col: str, kernel, new: list[T.StructField]) -> DataFrame:
    """``df`` with columns from ``kernel(arrow column) -> arrow arrays``; map only."""
    session.ship(df.sparkSession)
    src = session.spread(df.drop(*(f.name for f in new)))

    def f(batches):
        for b in batches:
            for part in pieces(b, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns, *kernel(part.column(text_col))], [*part.schema.names, *(x.name for x in new)])

    return src.mapInArrow(f, T.StructType([*src.schema.fields, *new]))


def embed_sparse(df: DataFrame, text_col: str, dim: int = schema.DIM) -> DataFrame:
    """``df`` with ``embedding``: array of (bucket, v), v the signed count of words in the bucket, zeros left out.

    A row stays where it is: the counts of one text need no shuffle.
    """

    def kernel(col):
        row, h = _word_hashes(col, True)
        bucket = (h % np.uint64(dim)).astype(np.int64)
        sign = np.where(h >> np.uint64(63), -1, 1)
        key, back = np.unique(row * dim + bucket, return_inverse=True)
        v = np.bincount(back, sign, len(key)).astype(np.int64)
        key, v = key[v != 0], v[v != 0]
        off = np.searchsorted(key // dim, np.arange(len(col) + 1))
        item = pa.StructArray.from_arrays([pa.array((key % dim).astype(np.int32)), pa.array(v.astype(np.int32))], ["bucket", "v"])
        return [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), item)]

    kind = T.ArrayType(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("v", T.IntegerType())]))
    return _mapped(df, text_col, kernel, [T.StructField("embedding", kind)])


def norm(embedding: Column) -> Column:
    return F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda a, x: a + x["v"].cast("double") * x["v"]))


#: Rows whose dense vectors are made at once.
_ROWS = 2048


def embed(df: DataFrame, text_col: str, out: str = "vector", dim: int = schema.DIM) -> DataFrame:
    """``df`` with the normalised vector of a text (array<float>); all zeros stay zero.  Map only."""

    def kernel(col):
        values = []
        for at in range(0, len(col), _ROWS):
            part = col.slice(at, _ROWS)
            row, h = _word_hashes(part, True)
            bucket = (h % np.uint64(dim)).astype(np.int64)
            v = np.bincount(row * dim + bucket, np.where(h >> np.uint64(63), -1.0, 1.0), len(part) * dim).astype(np.float64).reshape(-1, dim)
            n = np.sqrt((v * v).sum(1, keepdims=True))
            values.append(np.divide(v, n, out=v, where=n > 0).astype(np.float32).reshape(-1))
        flat = np.concatenate(values) if values else np.zeros(0, np.float32)
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(col) + 1, dtype=np.int32) * dim), pa.array(flat))]

    return _mapped(df, text_col, kernel, [T.StructField(out, T.ArrayType(T.FloatType()))])


#: Words whose bits are counted at once.
_WORDS = 1 << 16


def simhash_of_text(df: DataFrame, text_col: str, out: str = "simhash") -> DataFrame:
    """``df`` with the fingerprint of a text's tokens, each of weight 1: strict majority of the hashes' bits."""

    def kernel(col):
        row, h = _word_hashes(col, False)
        votes = np.zeros((len(col), 64), np.int64)
        for at in range(0, len(h), _WORDS):
            r, bits = row[at : at + _WORDS], np.unpackbits(h[at : at + _WORDS].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
            votes[r[first]] += 2 * ones - np.diff(np.append(first, len(r)))[:, None]
        return [pa.array(np.packbits(votes > 0, axis=1).view(">u8").reshape(-1).astype(np.uint64).view(np.int64))]

    return _mapped(df, text_col, kernel, [T.StructField(out, T.LongType())])


def simhash_tokens(tokens_col: Column) -> Column:
    """Fingerprint of array<struct<text, weight>>: per bit the sum of the weights with their signs; empty gives 0."""
    hashed = F.transform(tokens_col, lambda t: F.struct(hashing.fnv1a(t["text"]).alias("h"), t["weight"].cast("long").alias("w")))

    def vote(hashed: Column, b: int) -> Column:
        return F.aggregate(hashed, F.lit(0).cast("long"), lambda a, t: a + F.when(F.getbit(t["h"], F.lit(b)) == 1, t["w"]).otherwise(-t["w"]))

    def bits(hashed: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(64):
            out = out.bitwiseOR(F.when(vote(hashed, b) > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
        return out

    return F.transform(F.array(hashed), bits)[0]  # the hashes are bound once, not once a bit


@functools.lru_cache(1 << 12)
def _signs(text: str) -> np.ndarray:
    """1 or -1 for each bit of a text's hash, the lowest first; a parser's kinds are few and come again and again."""
    h = np.array([hashing.fnv_py(text.encode())], "<u8")
    return np.unpackbits(h.view(np.uint8), bitorder="little").astype(np.int64) * 2 - 1


def simhash_py(items: list[tuple[str, int]]) -> int:
    """The same in Python, signed, for parsers."""
    weights: dict[str, int] = {}
    for text, weight in items:
        weights[text] = weights.get(text, 0) + weight
    return _voted(frozenset(weights.items()))


@functools.lru_cache(1 << 12)
def _voted(weights: frozenset) -> int:
    votes = np.zeros(64, np.int64)
    for text, weight in weights:
        votes += weight * _signs(text)
    return int(np.packbits(votes > 0, bitorder="little").view("<i8")[0])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
