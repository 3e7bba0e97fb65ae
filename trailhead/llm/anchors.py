"""Repeated windows at scale: content-defined shards for the two substring operators.

A window is W consecutive units (words, or bytes) of one document; it is repeated if the same units start earlier, in a
smaller document or earlier in the same one.  An index of the whole corpus does not fit a machine, and every document
against every shard of a corpus split by documents is quadratic.  So shards are cut by content:

1. A window's anchor is the smallest hash of its k-grams.  Equal windows have equal anchors, so they meet in the shard
   that the anchor's hash names.  Consecutive windows of one anchor form a segment (its windows are contiguous).
2. Equal segments are collapsed, before the shuffle within each map task and after it in the shard.  Every later copy is
   repeated as a whole; only the first can hold something new.  A group of copies is thus one segment a map task.
3. An anchor with one distinct segment and no inner repeat needs nothing more.  For the others, the first occurrence's
   text is fetched, and the shard's index (given by the operator) tells which windows start earlier in another one.
4. Documents are cut.

Anchors that very many distinct segments share (the edges of a passage that a third of all documents quotes) are found in
a hashed 1/64 of the documents; their windows take their own hash as anchor instead, which spreads them over all shards.
The list only routes: any list gives the same result.  All tables between the steps are in the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashes, runtime

_BYTES = 1 << 19
#: Text of a map task between two flushes: equal segments within it are sent once.
_FLUSH = 8 << 20
HOT_SEGMENTS = 1 << 16
_HOT_LIMIT = 1 << 16
_SAMPLE = 64
_SEG = np.dtype([("a", "<u8"), ("h", "<u8"), ("k", "<i8"), ("p", "<i4"), ("n", "<i2"), ("r", "<i2")])
_PIECE = np.dtype([("k", "<i8"), ("p", "<i4"), ("n", "<i4"), ("len", "<i8")])
DUP, NEED = 1, 2
LONG = runtime.LONG


@dataclass(frozen=True)
class Scheme:
    """words: units are words between ASCII white space, else bytes; window and k in units."""

    words: bool
    window: int
    k: int

    def spans(self, data: np.ndarray, off: np.ndarray):
        """(starts, ends, first) of units in bytes."""
        if self.words:
            return hashes.word_spans(data, off, hashes.NOT_SPACE)
        return None, None, off

    def parts(self, data: np.ndarray, off: np.ndarray):
        """(bytes, offsets, units before) of texts; one long text comes in parts, each with the windows that begin in it."""
        if len(off) > 2 or len(data) <= LONG:
            yield data, off, 0
            return
        before, lap = 0, self.window - 1
        cuts = runtime.parts(data, hashes.NOT_SPACE, lap, LONG) if self.words else ((a, min(a + LONG + lap, len(data)), lap if a else 0) for a in range(0, max(len(data) - lap, 1), LONG))
        for a, b, repeats in cuts:
            part = data[a:b]
            yield part, np.array([0, b - a]), before - repeats
            before += (len(hashes.word_spans(part, np.array([0, b - a]), hashes.NOT_SPACE)[0]) if self.words else b - a) - repeats

    def units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.words:
            s, e, first = self.spans(data, off)
            return hashes.span_hashes(data, s, e), first
        return hashes.mix(data.astype(np.uint64)), off


def segments(scheme: Scheme, x: np.ndarray, first: np.ndarray, keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The segments of documents whose units are x."""
    w, g = scheme.window, hashes.grams(x, scheme.k)
    span = w - scheme.k + 1
    m = hashes.sliding_min(g, span)
    n = len(m)
    if not n:
        return np.zeros(0, _SEG)
    whole = hashes.grams(x, w)
    valid = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(first) >= w)
    np.add.at(valid, first[long], 1)
    np.add.at(valid, first[long + 1] - w + 1, -1)
    valid = np.cumsum(valid[:n], dtype=np.int8).astype(bool)
    a = m
    if len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, m), len(hot) - 1)] == m
        a = np.where(is_hot, hashes.mix(whole, 7), m)
    edge = np.empty(n, bool)
    edge[0] = True
    edge[1:] = (a[1:] != a[:-1]) | (valid[1:] != valid[:-1])
    edge[first[:-1][first[:-1] < n]] = True
    at = np.flatnonzero(edge)
    run = np.diff(np.append(at, n))
    most = min(w, 255)  # a run's length fits a byte, and its first and last window cover all of it
    if run.max() > most:  # long runs of one anchor (periodic text) are cut
        parts = -(-run // most)
        within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at = np.repeat(at, parts) + within * most
        run = np.diff(np.append(at, n))
    ok = valid[at]
    # inner repeats: the anchor's k-gram twice within reach
    pad = np.zeros(span - 1, np.uint64)
    high = ~hashes.sliding_min(~np.concatenate([pad, m, pad]), span)
    chosen = np.flatnonzero(high[: len(g)] == g)
    twice = np.flatnonzero((g[chosen[1:]] == g[chosen[:-1]]) & (np.diff(chosen) <= span))
    inner = np.zeros(n + 1, np.int32)
    np.add.at(inner, np.clip(chosen[twice] - span + 1, 0, n), 1)
    np.add.at(inner, np.clip(chosen[twice + 1] + 1, 0, n), -1)
    repeats = np.add.reduceat(np.cumsum(inner[:n]), at) > 0
    if len(hot):
        repeats |= is_hot[at] & (run > 1)
    at, run, repeats = at[ok], run[ok], repeats[ok]
    doc = np.searchsorted(first, at, "right") - 1
    out = np.empty(len(at), _SEG)
    out["a"], out["k"], out["p"], out["n"], out["r"] = a[at], keys[doc], at - first[doc], run, repeats
    with np.errstate(over="ignore"):
        out["h"] = hashes.mix(hashes.mix(whole[at], 3) * np.uint64(0x9E3779B97F4A7C15) + hashes.mix(whole[at + run - 1], 5) + run.astype(np.uint64))
    return out


def collapse(seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first occurrences, later copies).  Rows at the very place of the first (repeated rows) are neither."""
    seg = seg[np.lexsort((seg["p"], seg["k"], seg["h"], seg["a"]))]
    new = np.ones(len(seg), bool)
    new[1:] = (seg["a"][1:] != seg["a"][:-1]) | (seg["h"][1:] != seg["h"][:-1])
    lead = seg[new][np.cumsum(new) - 1] if len(seg) else seg
    later = ~new & ((seg["k"] != lead["k"]) | (seg["p"] != lead["p"]))
    return seg[new], seg[later]


def _segment_batches(scheme: Scheme, hot: np.ndarray, batches):
    """Segments of the batches' documents, in blocks of about _FLUSH bytes of text."""
    held, size = [], 0
    for batch in batches:
        data, off = runtime.bytes_of(batch.column("_t"))
        keys = batch.column("_k").to_numpy()
        for a, b in runtime.pieces(off, _BYTES):
            for d, o, before in scheme.parts(data[off[a] : off[b]], off[a : b + 1] - off[a]):
                x, first = scheme.units(d, o)
                got = segments(scheme, x, first, keys[a:b], hot)
                got["p"] += before
                held.append(got)
                size += len(d)
                if size >= _FLUSH:
                    yield np.concatenate(held)
                    held, size = [], 0
    if held:
        yield np.concatenate(held)


def _send(scheme: Scheme, hot, n_shards: int):
    empty = np.zeros(0, np.uint64)

    def f(batches):
        for seg in _segment_batches(scheme, hot.value if hot else empty, batches):
            firsts, later = collapse(seg)
            for kind, part, by in ((0, firsts, hashes.mix(firsts["a"], 11)), (DUP, later, hashes.mix(later["k"].view(np.uint64), 13))):
                if not len(part):
                    continue
                shard = (by % np.uint64(n_shards)).astype(np.int32)
                part = part[order := np.argsort(shard, kind="stable")]
                names, cut = np.unique(shard[order], return_index=True)
                load = [p.tobytes() for p in np.split(part, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), kind, np.int32)), pa.array(load, pa.binary())], ["shard", "kind", "load"])

    return f


def _by_document(keys: np.ndarray, items: np.ndarray, kind: int) -> pa.RecordBatch:
    order = np.argsort(keys, kind="stable")
    keys, items = keys[order], items[order]
    names, cut = np.unique(keys, return_index=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.int64()), pa.array(np.full(len(names), kind, np.int32)), pa.ListArray.from_arrays(pa.array(np.append(cut, len(keys)).astype(np.int32)), pa.array(items, pa.int64()))],
        ["_k", "kind", "items"],
    )


_LINKS = "_k long, kind int, items array<long>"


def pack(p: np.ndarray, n: np.ndarray, shard=0) -> np.ndarray:
    """Run of n windows from p (and its shard) as one number."""
    return (np.int64(shard) << 40) | (np.asarray(p).astype(np.int64) << 8) | np.asarray(n).astype(np.int64)


def unpack(items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (items >> 8) & 0xFFFFFFFF, items & 0xFF, items >> 40


def _resolve(n_shards: int, after: int | None = None):
    """``after``: documents up to this key were judged before; what concerns only them is left out."""

    def f(batches):
        loads: dict[int, list] = {0: [], DUP: []}
        for batch in batches:
            for kind, load in zip(batch.column("kind").to_pylist(), batch.column("load").to_pylist()):
                loads[kind].append(np.frombuffer(load, _SEG))
        if loads[DUP]:
            d = np.concatenate(loads.pop(DUP))
            yield _by_document(d["k"], pack(d["p"], d["n"]), DUP)
        if loads[0]:
            firsts, later = collapse(np.concatenate(loads[0]))
            if len(later):
                yield _by_document(later["k"], pack(later["p"], later["n"]), DUP)
            new = np.ones(len(firsts), bool)
            new[1:] = firsts["a"][1:] != firsts["a"][:-1]
            several = np.diff(np.append(np.flatnonzero(new), len(firsts)))[np.cumsum(new) - 1] > 1
            want = several | (firsts["r"] > 0)
            if after is not None:
                late = (firsts["k"] > after).astype(np.int64)
                group = np.cumsum(new) - 1
                want &= (np.bincount(group, late, group[-1] + 1) > 0)[group] if len(group) else want
                want &= several | (late > 0)
            need = firsts[want]
            if len(need):
                shard = (hashes.mix(need["a"], 11) % np.uint64(n_shards)).astype(np.int64)
                yield _by_document(need["k"], pack(need["p"], need["n"], shard), NEED)

    return f


def _cut(scheme: Scheme):
    """Texts of the needed segments, packed by shard."""

    def flush(held):
        for shard, (meta, texts) in held.items():
            m = np.concatenate(meta)
            yield shard, len(m).to_bytes(8, "little") + m.tobytes() + b"".join(texts)

    def f(batches):
        held, size = {}, 0
        for batch in batches:
            data, off = runtime.bytes_of(batch.column("_t"))
            lists = batch.column("items")
            for i, key in enumerate(batch.column("_k").to_pylist()):
                d = data[off[i] : off[i + 1]]
                s, e, first = scheme.spans(d, np.array([0, len(d)]))
                p, n, shard = unpack(np.sort(lists[i].values.to_numpy()))
                stop = p + n - 1 + scheme.window
                ok = stop <= (first[1] if scheme.words else len(d))
                p, n, shard, stop = p[ok], n[ok], shard[ok], stop[ok]
                lo, hi = (s[p], e[stop - 1]) if scheme.words else (p, stop)
                raw = d.tobytes()
                meta = np.empty(len(p), _PIECE)
                meta["k"], meta["p"], meta["n"], meta["len"] = key, p, n, hi - lo
                for j, (x, y, z) in enumerate(zip(shard.tolist(), lo.tolist(), hi.tolist())):
                    m, t = held.setdefault(x, ([], []))
                    m.append(meta[j : j + 1])
                    t.append(raw[y:z])
                    size += z - y
                if size >= _FLUSH:
                    rows = list(flush(held))
                    held, size = {}, 0
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "load"])
        if held:
            rows = list(flush(held))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "load"])

    return f


def _search(index):
    """Run the operator's index over a shard: pieces in order of (document, position), repeated rows once."""

    def f(batches):
        meta, texts = [], []
        for batch in batches:
            for load in batch.column("load").to_pylist():
                n = int.from_bytes(load[:8], "little")
                m = np.frombuffer(load, _PIECE, n, 8)
                at = 8 + n * _PIECE.itemsize + np.concatenate([[0], np.cumsum(m["len"])])
                meta.append(m)
                texts += [load[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        if not texts:
            return
        m = np.concatenate(meta)
        order = np.lexsort((m["p"], m["k"]))
        m = m[order]
        new = np.ones(len(m), bool)
        new[1:] = (m["k"][1:] != m["k"][:-1]) | (m["p"][1:] != m["p"][:-1])
        m, texts = m[new], [texts[i] for i in order[new]]
        piece, offset = index(texts, m["n"].astype(np.int64))  # windows that start earlier, ascending
        if len(piece):
            new = np.ones(len(piece), bool)
            new[1:] = (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1)
            at = np.flatnonzero(new)
            yield _by_document(m["k"][piece[at]], pack(m["p"][piece[at]] + offset[at], np.diff(np.append(at, len(piece)))), DUP)

    return f


def _hot(docs: DataFrame, scheme: Scheme, least: int) -> np.ndarray:
    """Anchors with very many distinct segments, by a hashed 1/64 of the documents (at most _HOT_LIMIT of them)."""

    def f(batches):
        for seg in _segment_batches(scheme, np.zeros(0, np.uint64), batches):
            seg = collapse(seg)[0]
            yield pa.RecordBatch.from_arrays([pa.array(seg["a"].view(np.int64)), pa.array(seg["h"].view(np.int64))], ["a", "h"])

    some = docs.where(F.pmod(F.xxhash64("_k"), F.lit(_SAMPLE)) == 0) if least > _SAMPLE else docs
    many = some.mapInArrow(f, "a long, h long").distinct().groupBy("a").count().where(F.col("count") >= max(2, least // _SAMPLE))
    rows = many.orderBy(F.desc("count"), "a").limit(_HOT_LIMIT).collect()
    return np.sort(np.array([r.a for r in rows], np.int64).view(np.uint64))


MARKS, LOADS = "_k long, items array<long>", "shard int, kind int, load binary"
#: Bytes of text that a shard stands for at most: shards are as many as shuffle partitions, or more by this.
SHARD_BYTES = 64 << 20


def hot_anchors(docs: DataFrame, scheme: Scheme, hot_segments: int = HOT_SEGMENTS) -> np.ndarray:
    return _hot(docs, scheme, hot_segments)


def repeats(docs: DataFrame, scheme: Scheme, index, hot_segments: int = HOT_SEGMENTS, shards: int | None = None) -> DataFrame:
    """(_k, items): the runs of repeated windows of each document in ``docs`` (_k, _t) that has any."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("_t")), F.lit(0))).first()[0]
    n = shards or max(runtime.partitions(docs.sparkSession), -(-size // SHARD_BYTES))
    return _judged(docs, docs, [], scheme, index, _hot(docs, scheme, hot_segments), n, None)[0]


def repeats_against(docs: DataFrame, earlier: DataFrame | None, levels: list[DataFrame], scheme: Scheme, index, hot: np.ndarray, n: int, after: int | None) -> tuple[DataFrame, DataFrame]:
    """(marks of ``docs``, their level): as ``repeats``, against ``earlier`` texts, whose segments the levels hold."""
    every = docs.unionByName(earlier) if earlier is not None else docs
    marks, sent = _judged(docs, every, levels, scheme, index, hot, n, after)
    return marks, sent.repartitionById(n, "shard").mapInArrow(_fresh(after), LOADS)


def _judged(docs, texts, levels, scheme, index, hot, n, after) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(hot) if len(hot) else None
    sent = docs.mapInArrow(_send(scheme, shared, n), LOADS)
    for x in levels:
        sent = sent.unionByName(x)
    if after is not None or levels:
        sent = runtime.stored(sent, "sent")
    links = runtime.stored(sent.repartitionById(n, "shard").mapInArrow(_resolve(n, after), _LINKS), "links")
    needs = links.where(F.col("kind") == NEED).groupBy("_k").agg(F.flatten(F.collect_list("items")).alias("items"))
    pieces = texts.join(needs, "_k").mapInArrow(_cut(scheme), "shard int, load binary").repartitionById(n, "shard")
    marks = pieces.mapInArrow(_search(index), _LINKS).unionByName(links.where(F.col("kind") == DUP))
    marks = marks if after is None else marks.where(F.col("_k") > after)
    return marks.groupBy("_k").agg(F.flatten(F.collect_list("items")).alias("items")), sent


def _fresh(after: int | None):
    """The first occurrences of a shard that a level does not hold yet."""

    def f(batches):
        seg, shard = [], None
        for batch in batches:
            for s, kind, load in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "load"))):
                if kind == 0:
                    seg.append(np.frombuffer(load, _SEG))
                    shard = s
        if seg:
            firsts = collapse(np.concatenate(seg))[0]
            firsts = firsts if after is None else firsts[firsts["k"] > after]
            if len(firsts):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([0], pa.int32()), pa.array([firsts.tobytes()], pa.binary())], ["shard", "kind", "load"])

    return f


def level(loads: DataFrame, n: int) -> DataFrame:
    """Levels as one."""
    return loads.repartitionById(n, "shard").mapInArrow(_fresh(None), LOADS)


def removed(items: np.ndarray, window: int, n: int) -> np.ndarray:
    """(m, 2): the maximal runs of units under runs of windows, of a text of n units."""
    if not len(items):
        return np.zeros((0, 2), np.int64)
    p, run, _ = unpack(np.sort(items & 0xFFFFFFFFFF))
    end = np.maximum.accumulate(np.minimum(p + run - 1 + window, n))
    new = np.ones(len(p), bool)
    new[1:] = p[1:] > end[:-1]
    at = np.flatnonzero(new)
    return np.stack([p[at], end[np.append(at[1:], len(p)) - 1]], 1)


def rest(spans: np.ndarray, n: int) -> np.ndarray:
    """(m, 2): the runs between the spans, none empty."""
    cuts = np.concatenate([[0], spans.reshape(-1), [n]]).reshape(-1, 2)
    return cuts[cuts[:, 0] < cuts[:, 1]]


def remove(docs: DataFrame, marks: DataFrame, cutter, new: list[T.StructField]) -> DataFrame:
    """``docs`` (with _k, _t) through ``cutter(bytes, items) -> values of the new columns``."""
    keep = [c for c in docs.columns if c not in ("_k", "_t")]
    joined = docs.join(marks, "_k", "left").select(*keep, "_t", "items")

    def f(batches):
        for batch in batches:
            data, off = runtime.bytes_of(batch.column("_t"))
            raw, lists, none = data.tobytes(), batch.column("items"), np.zeros(0, np.int64)
            rows = [cutter(raw[off[i] : off[i + 1]], lists[i].values.to_numpy() if lists[i].is_valid else none) for i in range(batch.num_rows)]
            cols = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols], [*keep, *(x.name for x in new)])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(x.dataType) for x in new]
    return joined.mapInArrow(f, T.StructType([*(docs.schema[c] for c in keep), *new]))
