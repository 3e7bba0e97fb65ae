"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

Pre-tokens are the matches of the public pattern (contractions; letters, digits or other signs with an optional space
before them; white space).  No regex runs: each code point has a class, a class is a function from automaton states to
states, and functions compose associatively.  A blocked scan composes them for every block at once, a doubling scan over
the blocks gives each block's entry state, and a replay gives the state after every code point.  A pre-token starts
where a few neighbouring states say so.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashes, runtime

LONG = runtime.LONG
_STEP, _AT_ONCE = 1 << 16, 1 << 20
# classes of code points
LETTER, NUMBER, SPACE, WHITE, OTHER, APOS, SINGLE, R, V, L, E, END = range(12)
# states after a code point
NONE, IN_L, IN_N, IN_O, IN_SP, IN_W, AT_A, AT_R, AT_V, AT_L, DONE = range(11)
_K = 11
#: The code points of Unicode's White_Space property but for U+0020.
WHITE_SPACE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers that Unicode 16 added and Python's table may lack.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
_BLOCK = 64
_BYTES = 1 << 20
_CACHE = 3 << 17
_SHORT = 32
_FAR = 1 << 60
_CACHED_BYTES = 48


@lru_cache(1)
def classes() -> np.ndarray:
    """Class by code point; the last entry is the end of a text."""
    kind = {"L": LETTER, "N": NUMBER}
    t = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for ranges, c in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for a, b in ranges:
            t[a : b + 1] = c
    t = np.append(t, np.uint8(END))
    t[WHITE_SPACE] = WHITE
    t[0x20], t[0x27] = SPACE, APOS
    for letters, c in (("stmd", SINGLE), ("r", R), ("v", V), ("l", L), ("e", E)):
        t[[ord(x) for x in letters]] = c
    return t


@lru_cache(1)
def transitions() -> np.ndarray:
    """next state = transitions[class * 16 + state]."""
    t = np.zeros((12, 16), np.uint8)
    for c, s in ((NUMBER, IN_N), (SPACE, IN_SP), (WHITE, IN_W), (OTHER, IN_O), (END, NONE)):
        t[c] = s
    t[APOS] = AT_A  # may open a contraction unless a space or another sign comes before it
    t[APOS, [IN_O, IN_SP, AT_A]] = IN_O
    for c in (LETTER, SINGLE, R, V, L, E):
        t[c] = IN_L
    t[SINGLE, AT_A], t[R, AT_A], t[V, AT_A], t[L, AT_A] = DONE, AT_R, AT_V, AT_L
    t[E, AT_R] = t[E, AT_V] = t[L, AT_L] = DONE
    return t.reshape(-1)


def states(cls: np.ndarray) -> np.ndarray:
    """The state after each code point, by an associative scan over transition functions."""
    n = len(cls)
    block = _BLOCK if n > _BLOCK * _BLOCK else 8  # short texts: fewer steps
    rows = -(-n // block)
    c = np.full(rows * block, END, np.uint16)
    c[:n] = cls
    c = np.ascontiguousarray(c.reshape(rows, block).T) * 16
    t = transitions()
    f = np.tile(np.arange(_K, dtype=np.uint8), (rows, 1))
    for j in range(block):  # f[row]: the block's function so far
        f = t[c[j][:, None] + f]
    step = 1
    while step < rows:  # f[row]: the function of all blocks up to this one
        f[step:] = np.take_along_axis(f[step:], f[:-step].copy(), 1)
        step *= 2
    s = np.zeros(rows, np.uint8)
    s[1:] = f[:-1, NONE]
    out = np.empty((block, rows), np.uint8)
    for j in range(block):
        s = out[j] = t[c[j] + s]
    return out.T.reshape(-1)[:n]


def starts(cls: np.ndarray) -> np.ndarray:
    """True where a pre-token starts.  ``cls`` has an END after each text."""
    st = states(cls)
    pre = np.concatenate([[np.uint8(NONE)], st[:-1]])
    post = np.append(st[1:], np.uint8(NONE))
    is_in = lambda x, *which: np.isin(np.arange(_K), which)[x]
    begun = np.zeros(len(cls), bool)
    letter = is_in(st, IN_L)
    begun |= letter & ~is_in(pre, IN_SP, IN_L, AT_R, AT_V, AT_L)
    begun |= is_in(st, AT_R, AT_V, AT_L) & (post != DONE)
    begun |= (st == IN_N) & ~is_in(pre, IN_N, IN_SP)
    begun |= is_in(st, IN_O, AT_A) & ~is_in(pre, IN_O, AT_A, IN_SP)
    white, before, after = is_in(st, IN_SP, IN_W), is_in(pre, IN_SP, IN_W), is_in(post, IN_SP, IN_W)
    last = ~after & (np.append(cls[1:], np.uint8(END)) != END)
    return begun | white & (~before | last)


def _safe(data: np.ndarray, near: int) -> int:
    """A place at or after ``near`` where a pre-token starts whatever is around it: a space between two ASCII letters."""
    while near < len(data):
        part = hashes.LOWER[data[near - 1 : near + _STEP]]
        letter = (part >= 97) & (part <= 122)
        at = np.flatnonzero(letter[:-2] & (part[1:-1] == 32) & letter[2:])
        if len(at):
            return near + int(at[0])
        near += _STEP - 1
    return len(data)


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets of pre-token starts and the end, index of each document's first pre-token).

    A long text is taken in parts that begin where a pre-token is sure to.
    """
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    if len(data) > LONG and len(offsets) == 2:
        found, a = [], 0
        while a < len(data):
            b = _safe(data, min(a + LONG, len(data)))
            found.append(_boundaries(data[a:b], np.array([0, b - a]))[0][:-1] + a)
            a = b
        at = np.concatenate(found)
        return np.append(at, len(data)), np.array([0, len(at)])
    return _boundaries(data, offsets)


def _boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    ends = np.searchsorted(at, offsets[1:])
    cls = np.insert(classes()[points], ends, END)
    begun = starts(cls)
    begun = begun[cls != END]
    at = at[begun]
    return np.append(at, len(data)), np.searchsorted(at, offsets)


class Encoder:
    """Ids of pre-tokens by merges in rank order; frequent pre-tokens come from a bounded cache."""

    def __init__(self, ranks_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        size = max(self.ranks.values()) + 1
        words = [b""] * size
        for w, i in self.ranks.items():
            words[i] = w
        self.lens = np.array([len(w) for w in words], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.lens)])
        self.flat = np.frombuffer(b"".join(words), np.uint8)
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.older = self.cache

    def __missing(self, token: bytes) -> tuple[int, ...]:
        ids = self.cache.get(token) or self.older.get(token)  # the caller may still hold the older one
        if ids is None:
            rank = self.ranks.get(token)
            ids = (rank,) if rank is not None else tuple(self.short(token) if len(token) <= _SHORT else self.merged(token))
        if len(token) <= _CACHED_BYTES:
            if len(self.cache) >= _CACHE:  # two generations: what was used lately stays
                self.older, self.cache = self.cache, {}
            self.cache[token] = ids
        return ids

    def short(self, token: bytes) -> list[int]:
        """Merges of a short pre-token: the lowest rank of a small list, again and again."""
        rank = self.ranks.get
        parts = [token[i : i + 1] for i in range(len(token))]
        pairs = [rank(token[i : i + 2], _FAR) for i in range(len(token) - 1)]
        while pairs and (low := min(pairs)) < _FAR:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], _FAR)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], _FAR)
        return [self.ranks[p] for p in parts]

    def merged(self, token: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals, by a heap over a linked list: n log n for any length."""
        ranks, n = self.ranks, len(token)
        end, nxt, prv, dead = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n + 1)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if not dead[i] else n
            if j >= n or end[j] != stop:
                continue
            dead[j] = 1
            end[i], nxt[i] = stop, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                if (r := ranks.get(token[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if (p := prv[i]) >= 0 and (r := ranks.get(token[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[token[i : end[i]]])
            i = nxt[i]
        return ids

    def tokens(self, raw: bytes, bounds: np.ndarray) -> list[tuple[int, ...]]:
        """The ids of each slice between bounds."""
        get, miss, cuts = self.cache.get, self.__missing, bounds.tolist()
        return [get(w) or miss(w) for w in map(raw.__getitem__, map(slice, cuts, cuts[1:]))]

    def ids(self, raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each pre-token, all ids)."""
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for a in range(0, len(bounds) - 1, _AT_ONCE):
            toks = self.tokens(raw, bounds[a : a + _AT_ONCE + 1])
            sizes.append(np.fromiter(map(len, toks), np.int64, len(toks)))
            ids.append(np.fromiter(chain.from_iterable(toks), np.int32, int(sizes[-1].sum())))
        return np.concatenate(sizes), np.concatenate(ids)

    def decode(self, ids: np.ndarray) -> bytes:
        lens = self.lens[ids]
        to = np.cumsum(lens)
        return self.flat[np.arange(to[-1] if len(to) else 0) + np.repeat(self.at[ids] - to + lens, lens)].tobytes()


_encoders: dict[int, Encoder] = {}


def encoder(shared) -> Encoder:
    """One encoder a worker process and vocabulary."""
    if shared.id not in _encoders:
        _encoders.clear()
        _encoders[shared.id] = Encoder(shared.value)
    return _encoders[shared.id]


class Vocabulary:
    """The ranks file as a broadcast: read once on the driver; vocabularies are a few MB and the size is checked."""

    LIMIT = 64 << 20

    def __init__(self, spark: SparkSession, path: str):
        fs, p = runtime.fs_of(path)
        with fs.open_input_stream(p) as f:
            raw = f.read()
        if len(raw) > self.LIMIT:
            raise ValueError(f"{path} has {len(raw)} bytes; a ranks file has at most {self.LIMIT}")
        self.id = hash(raw)
        self._sent = spark.sparkContext.broadcast(raw)

    @property
    def value(self) -> bytes:
        return self._sent.value


def _lists(values: np.ndarray, offsets: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _encode(shared, text: str, keep: list[str]):
    def f(batches):
        enc = encoder(shared)
        for batch in batches:
            data, off = runtime.texts_of(batch.column(text))
            for a, b in runtime.pieces(off, _BYTES):
                d = data[off[a] : off[b]]
                bounds, first = boundaries(d, off[a : b + 1] - off[a])
                sizes, ids = enc.ids(d.tobytes(), bounds)
                cuts = np.concatenate([[0], np.cumsum(sizes)])[first]
                to = np.cumsum(enc.lens[ids])
                base = np.repeat(off[a:b] - off[a], np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in keep), _lists(ids, cuts, pa.int32()), _lists((to - base).astype(np.int32), cuts, pa.int32())],
                    [*keep, "ids", "ends"],
                )

    return f


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``ends`` (byte offset of each id's end in the text); map only.

    Null and empty texts have empty arrays; bytes that are no UTF-8 are read as U+FFFD, and the ends are of that text.  All other columns pass through unchanged; columns that are called ids or
    ends already are replaced.  Repeated rows are encoded each.  Empty input: no rows.
    """
    spark = docs.sparkSession
    runtime.tune(spark)
    src = docs.drop("ids", "ends")
    keep = src.columns
    schema = T.StructType([*src.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(_encode(Vocabulary(spark, vocabulary), text_col, keep), schema)


def _decode(shared, keep: list[str]):
    def f(batches):
        enc = encoder(shared)
        for batch in batches:
            n = batch.num_rows
            lists, tails = batch.column("ids"), batch.column("ends")
            o = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False)[o[0] : o[-1]]
            o = o - o[0]
            done = []
            for i in range(n):
                part = enc.decode(ids[o[i] : o[i + 1]])
                last = tails[i].values
                if len(last) and last[-1].as_py() != len(part):
                    raise ValueError("ids and offsets do not belong together")
                done.append(part)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists, pa.array(done, pa.binary())], [*keep, "ids", "decoded"])

    return f


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` (with ids, ends) without ``ends``, with ``decoded`` (binary); offsets that do not fit the ids raise.

    Null ids decode to no bytes.
    """
    spark = encoded.sparkSession
    runtime.tune(spark)
    src = encoded.withColumns({c: F.coalesce(F.col(c), F.array().cast("array<int>")) for c in ("ids", "ends")})
    keep = [c for c in src.columns if c not in ("ids", "ends", "decoded")]
    kinds = {f.name: f for f in src.schema.fields}
    schema = T.StructType([*(kinds[c] for c in keep), kinds["ids"], T.StructField("decoded", T.BinaryType())])
    return src.select(*keep, "ids", "ends").mapInArrow(_decode(Vocabulary(spark, vocabulary), keep), schema)
