"""Benchmark decontamination by winnowing.

Words are lower-cased ASCII letters, digits and non-ASCII characters.  A benchmark window is ``WINDOW`` consecutive words
of an item (a shorter item is one window).  Both sides keep the minimum hash of the k-grams in every window; a window that
occurs on both sides has the same minimum there, so every shared span of WINDOW words or more is found.  Items of
n < WINDOW words are kept as n-grams.  Document windows whose minimum is a benchmark fingerprint are then extended to the
whole window: its hash is looked up among the items' windows, where equal windows of many items are one entry.  A gram
that many documents share with many items thus costs one look-up a window, whatever the number of items.

A benchmark of at most ``BLOCK_BYTES`` of text, measured before, travels to the documents, which stay where they are;
found windows are compared word by word.  A larger one is joined: fingerprints first, then the windows of those documents
that share one.  Both are equi-joins, the second on the windows' own words too, so equal hashes of different words do not
meet.  A document sends a fingerprint once, however often it has it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashes, runtime

WINDOW = 10
GRAM = 5
BLOCK_BYTES = 8 << 20
_BYTES = 1 << 20
#: A text of more bytes is searched in parts that overlap by a window.
LONG = 8 << 20
_MARKS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("items", T.ArrayType(T.StringType()))]


def words_of(data: np.ndarray, offsets: np.ndarray):
    """(lower-cased bytes, starts, ends, first word of each document, hash of each word)."""
    low = hashes.LOWER[data]
    starts, ends, first = hashes.word_spans(low, offsets, hashes.ALNUM)
    return low, starts, ends, first, hashes.span_hashes(low, starts, ends)


def winnow(x: np.ndarray, window: int = WINDOW, k: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, fingerprints): windows that start in [start, end) have this minimum hash of their k-grams."""
    low = hashes.sliding_min(hashes.grams(x, k), window - k + 1)
    edge = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1], [True]])) if len(low) else np.zeros(1, np.int64)
    return edge[:-1], edge[1:], low[edge[:-1]]


def _spread(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value): the numbers of all ranges [a, b)."""
    n = b - a
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a[which]


def _found(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with values[i] == keys[j]; keys are sorted and differ."""
    if not len(keys) or not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    j = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    i = np.flatnonzero(keys[j] == values)
    return i, j[i]


def _inside(at: np.ndarray, n: int, first: np.ndarray) -> np.ndarray:
    """Whether the n words from each place are of one document."""
    return at + n <= first[np.searchsorted(first, at, "right").clip(max=len(first) - 1)]


@dataclass
class Windows:
    """The distinct windows of n words: sorted hashes, a word that begins each, and the items that have it."""

    hashes: np.ndarray
    word: np.ndarray
    offsets: np.ndarray
    items: np.ndarray


@dataclass
class Index:
    names: list[str]
    prints: np.ndarray  # sorted fingerprints of items of WINDOW words or more
    windows: dict[int, Windows]
    low: bytes
    starts: np.ndarray
    ends: np.ndarray


def _item_windows(first: np.ndarray, x: np.ndarray):
    """(n, places) of all items' windows, n ascending."""
    size = np.diff(first)
    for n in sorted({min(int(s), WINDOW) for s in size if s}):
        its = np.flatnonzero(size >= WINDOW) if n == WINDOW else np.flatnonzero(size == n)
        yield n, _spread(first[its], first[its] + size[its] - n + 1)[1]


def build(names: list[str], texts: list[str | None]) -> Index:
    order = np.argsort(np.array(names, object), kind="stable")
    known, rank = np.unique(np.array(names, object)[order], return_inverse=True) if names else (np.zeros(0, object), order)
    raw = [(texts[i] or "").encode("utf-8", "surrogatepass") for i in order]
    low, s, e, first, x = words_of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]))
    windows, prints = {}, np.zeros(0, np.uint64)
    for n, at in _item_windows(first, x):
        h, item = hashes.grams(x, n)[at], rank[np.searchsorted(first, at, "right") - 1]
        o = np.lexsort((item, h))
        h, item, at = h[o], item[o], at[o]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1])
        h, item, at = h[fresh], item[fresh], at[fresh]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        windows[n] = Windows(h[head], at[head], np.append(head, len(h)), item)
        if n == WINDOW:
            prints = np.unique(hashes.sliding_min(hashes.grams(x, GRAM), WINDOW - GRAM + 1)[at])
    return Index([str(k) for k in known], prints, windows, low.tobytes(), s, e)


def candidates(index_lengths, prints: np.ndarray, x: np.ndarray, first: np.ndarray):
    """(n, places): the document windows that may be benchmark windows."""
    for n in index_lengths:
        if n == WINDOW:
            a, b, k = winnow(x)
            i, _ = _found(prints, k)
            at = _spread(a[i], b[i])[1]
        else:
            at = np.arange(max(len(x) - n + 1, 0))
        yield n, at[_inside(at, n, first)]


def search(index: Index, low: np.ndarray, starts, ends, first, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hit words, documents, items): which words are hit, and the pairs of a document and an item that occurs in it."""
    hit, pairs, raw = np.zeros(len(x) + 1, np.int64), [np.zeros((0, 2), np.int64)], None
    for n, at in candidates(index.windows, index.prints, x, first):
        w = index.windows[n]
        if not len(at):
            continue
        i, j = _found(w.hashes, hashes.grams(x, n)[at])
        if not len(i):
            continue
        raw = low.tobytes() if raw is None else raw

        def same(p: int, q: int, n=n) -> bool:
            if raw[starts[p] : ends[p + n - 1]] == index.low[index.starts[q] : index.ends[q + n - 1]]:
                return True
            return all(raw[starts[p + k] : ends[p + k]] == index.low[index.starts[q + k] : index.ends[q + k]] for k in range(n))

        good = np.array([same(p, q) for p, q in zip(at[i].tolist(), w.word[j].tolist())], bool)
        p, j = at[i[good]], j[good]
        np.add.at(hit, p, 1)
        np.add.at(hit, p + n, -1)
        met = np.unique(np.stack([np.searchsorted(first, p, "right") - 1, j], 1), axis=0)
        which, k = _spread(w.offsets[met[:, 1]], w.offsets[met[:, 1] + 1])
        pairs.append(np.stack([met[which, 0], w.items[k]], 1))
    every = np.unique(np.concatenate(pairs), axis=0)
    return np.cumsum(hit[:-1]) > 0, every[:, 0], every[:, 1]


def _parts(data: np.ndarray):
    return runtime.parts(data, hashes.ALNUM, WINDOW - 1, LONG)


def _long(index: Index, data: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(hit words, items) of one long text."""
    hits, items = np.zeros(0, bool), set()
    for a, b, repeats in _parts(data):
        low, s, e, first, x = words_of(data[a:b], np.array([0, b - a]))
        hit, _, its = search(index, low, s, e, first, x)
        if repeats:
            hits[-repeats:] |= hit[:repeats]
        hits = np.concatenate([hits, hit[repeats:]])
        items.update(its.tolist())
    return hits, sorted(items)


def _spans(hit: np.ndarray) -> list:
    if not hit.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def _scan(sent, text: str, keep: list[str]):
    def f(batches):
        index = sent.value
        for batch in batches:
            data, off = runtime.bytes_of(batch.column(text))
            for a, b in runtime.pieces(off, _BYTES):
                if b == a + 1 and off[b] - off[a] > LONG:
                    hit, its = _long(index, data[off[a] : off[b]])
                    first, doc, item = np.array([0, len(hit)]), np.zeros(len(its), np.int64), its
                else:
                    low, s, e, first, x = words_of(data[off[a] : off[b]], off[a : b + 1] - off[a])
                    hit, doc, item = search(index, low, s, e, first, x)
                found = [[] for _ in range(b - a)]
                for d, i in zip(doc, item):
                    found[d].append(index.names[i])
                total = np.concatenate([[0], np.cumsum(hit)])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in keep), pa.array(np.diff(first)), pa.array(np.diff(total[first])), pa.array([_spans(hit[p:q]) for p, q in zip(first[:-1], first[1:])], pa.list_(pa.list_(pa.int32()))), pa.array(found, pa.list_(pa.string()))],
                    [*keep, *(m.name for m in _MARKS)],
                )

    return f


# --- a benchmark that is too large to travel


def _both(low: np.ndarray, s: np.ndarray, e: np.ndarray, x: np.ndarray, n: int, at: np.ndarray) -> list:
    """The hash and the words, spaces between them, of the windows at these places."""
    raw = low.tobytes()
    words = [b" ".join(raw[s[i] : e[i]] for i in range(p, p + n)) for p in at.tolist()]
    return [pa.array(hashes.grams(x, n)[at].view(np.int64)), pa.array(words, pa.binary())]


def _bench_windows(batches):
    """(n, w1, words, print, item) of every window of the items ``i``, ``t``; the print of a shorter one is its hash."""
    for batch in batches:
        data, off = runtime.bytes_of(batch.column("t"))
        low, s, e, first, x = words_of(data, off)
        for n, at in _item_windows(first, x):
            w1, w2 = _both(low, s, e, x, n, at)
            k = pa.array(hashes.sliding_min(hashes.grams(x, GRAM), WINDOW - GRAM + 1)[at].view(np.int64)) if n == WINDOW else w1
            item = batch.column("i").take(pa.array(np.searchsorted(first, at, "right") - 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), w1, w2, k, item], ["n", "w1", "words", "print", "item"])


def _doc_prints(lengths: list[int]):
    """(h1, h2, n, print, a, b): windows of n words from a to b of the text h1, h2 that have this print.  A print of fewer words
    than WINDOW comes once a text, without its places (b is -1)."""

    def f(batches):
        for batch in batches:
            data, off = runtime.bytes_of(batch.column("_t"))
            for r in range(batch.num_rows):
                for start, end, skipped, base in _texts(data[off[r] : off[r + 1]]):
                    _, _, _, _, x = words_of(data[off[r] + start : off[r] + end], np.array([0, end - start]))
                    for n in lengths:
                        if n == WINDOW:
                            a, b, k = winnow(x)
                        else:
                            k = np.unique(hashes.grams(x, n))
                            a, b = np.full(len(k), skipped - base), np.full(len(k), skipped - base - 1)
                        if len(k):
                            head = [pa.array(np.full(len(k), batch.column(c)[r].as_py(), np.int64)) for c in ("h1", "h2")]
                            yield pa.RecordBatch.from_arrays([*head, pa.array(np.full(len(k), n, np.int32)), pa.array(k.view(np.int64)), pa.array(a + base - skipped), pa.array(b + base - skipped)], ["h1", "h2", "n", "print", "a", "b"])

    return f


def _texts(data: np.ndarray):
    """(start, end, repeated words, words before) of a text's parts."""
    before = 0
    for a, b, repeats in _parts(data) if len(data) > LONG else [(0, len(data), 0)]:
        yield a, b, repeats, before
        before += len(hashes.word_spans(data[a:b], np.array([0, b - a]), hashes.ALNUM)[0]) - repeats


def _doc_windows(batches):
    """(h1, h2, n, s, w1, words) of the windows in ``at`` (n, a, b, print) of each text."""
    for batch in batches:
        data, off = runtime.bytes_of(batch.column("_t"))
        for r in range(batch.num_rows):
            low = hashes.LOWER[data[off[r] : off[r + 1]]]
            s, e, _ = hashes.word_spans(low, np.array([0, len(low)]), hashes.ALNUM)
            x = hashes.span_hashes(low, s, e)
            at = np.array([(v["n"], v["a"], v["b"], v["print"]) for v in batch.column("at")[r].as_py()], np.int64).reshape(-1, 4)
            for n in np.unique(at[:, 0]).tolist():
                mine = at[at[:, 0] == n]
                if n == WINDOW:
                    p = np.unique(_spread(mine[:, 1], mine[:, 2])[1])
                else:
                    p = np.flatnonzero(np.isin(hashes.grams(x, n).view(np.int64), mine[:, 3]))
                head = [pa.array(np.full(len(p), batch.column(c)[r].as_py(), np.int64)) for c in ("h1", "h2")]
                yield pa.RecordBatch.from_arrays([*head, pa.array(np.full(len(p), n, np.int32)), pa.array(p), *_both(low, s, e, x, n, p)], ["h1", "h2", "n", "s", "w1", "words"])


def _marked(text: str, keep: list[str]):
    """The marks from the joined columns _at (n, s) and _items."""

    def f(batches):
        for batch in batches:
            data, off = runtime.bytes_of(batch.column(text))
            first = np.concatenate([[0], np.cumsum([len(hashes.word_spans(data[p:q], np.array([0, q - p]), hashes.ALNUM)[0]) for p, q in zip(off[:-1], off[1:])])]).astype(np.int64)
            hits = []
            for r, at in enumerate(batch.column("_at").to_pylist()):
                d = np.zeros(first[r + 1] - first[r] + 1, np.int64)
                for v in at or ():
                    d[v["s"]] += 1
                    d[v["s"] + v["n"]] -= 1
                hits.append(np.cumsum(d[:-1]) > 0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(np.diff(first)), pa.array([int(h.sum()) for h in hits], pa.int64()), pa.array([_spans(h) for h in hits], pa.list_(pa.list_(pa.int32()))), pa.array([v or [] for v in batch.column("_items").to_pylist()], pa.list_(pa.string()))],
                [*keep, *(m.name for m in _MARKS)],
            )

    return f


def _joined(src: DataFrame, items: DataFrame, text_col: str) -> DataFrame:
    h1, h2 = F.xxhash64("_t"), F.xxhash64(F.lit(11), "_t")
    window = ["n", "w1", "words"]
    bench = runtime.stored(items.mapInArrow(_bench_windows, "n int, w1 long, words binary, print long, item string").distinct(), "windows")
    lengths = sorted(r.n for r in bench.select("n").distinct().collect())  # ten at most
    texts = src.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_t")).select("_t", h1.alias("h1"), h2.alias("h2"))
    sent = texts.mapInArrow(_doc_prints(lengths), "h1 long, h2 long, n int, print long, a long, b long").distinct()
    shared = sent.join(bench.select("n", "print").distinct(), ["n", "print"], "left_semi").groupBy("h1", "h2").agg(F.collect_list(F.struct("n", "a", "b", "print")).alias("at"))
    near = texts.join(shared, ["h1", "h2"]).dropDuplicates(["h1", "h2"])
    hits = near.mapInArrow(_doc_windows, "h1 long, h2 long, n int, s long, w1 long, words binary").join(bench.select(*window).distinct(), window, "left_semi")
    hits = runtime.stored(hits, "hits")
    at = hits.groupBy("h1", "h2").agg(F.collect_list(F.struct("n", "s")).alias("_at"))
    named = hits.select("h1", "h2", *window).distinct().join(bench, window).groupBy("h1", "h2").agg(F.array_sort(F.collect_set("item")).alias("_items"))
    found = at.join(named, ["h1", "h2"]).withColumnsRenamed({"h1": "_h1", "h2": "_h2"})
    key = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    met = src.withColumns({"_k1": F.xxhash64(key), "_k2": F.xxhash64(F.lit(11), key)}).join(found, (F.col("_k1") == F.col("_h1")) & (F.col("_k2") == F.col("_h2")), "left")
    return met.select(*(F.col(f"`{c}`") for c in src.columns), "_at", "_items").mapInArrow(_marked(text_col, src.columns), T.StructType([*src.schema.fields, *_MARKS]))


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_bytes: int | None = None) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_spans (word ranges [start, end)) and items (sorted names that occur).

    Null and empty texts have no words, and an item without words never occurs.  Items repeated under one id count once;
    a null item id is called "null".  Columns of ``docs`` with the names of the four are replaced, all others pass
    through; repeated rows are marked each.  Empty tables: no rows, or no hits.  Very long texts are searched in parts.
    Bytes that are no UTF-8 are letters like any other above ASCII.
    """
    runtime.tune(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + F.octet_length("i")), F.lit(0))).first()[0]
    names = [m.name for m in _MARKS]
    src, kept = runtime.plain(docs.drop(*names))
    text = src.columns[kept.index(text_col)]
    if size <= (BLOCK_BYTES if broadcast_bytes is None else broadcast_bytes):
        rows = items.distinct().collect()  # bounded by the line above
        sent = docs.sparkSession.sparkContext.broadcast(build([r.i for r in rows], [r.t for r in rows]))
        marked = src.mapInArrow(_scan(sent, text, src.columns), T.StructType([*src.schema.fields, *_MARKS]))
    else:
        marked = _joined(src, items, text)
    return marked.toDF(*kept, *names)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with their own columns."""
    names = {f"_d{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}  # so that no column clashes with a mark
    plain = docs.select(*(c.alias(k) for k, c in names.items()))
    at = f"_d{docs.columns.index(text_col)}"
    return mark(plain, benchmark, at).where("n_hit = 0").select(*(F.col(k).alias(c) for k, c in zip(names, docs.columns)))
