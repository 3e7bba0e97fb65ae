"""Suffix-array dedup: repeated byte strings by a logarithmic family of suffix arrays.

``anchors`` deals windows of bytes out to shards by content and fetches the distinct passages that may share a window.
A shard takes its passages in document order, a batch at a time.  A batch gets a suffix array of its window starts (order
of the first W bytes); equal neighbours are repeats inside the batch.  The others are merge-scanned against every level
of the family: both sides are sorted, so a search by the leading eight bytes and a bisection among equals finds matches
of W bytes.  What the levels hold came before.  Then the batch joins the family as the lowest level, and levels of equal
rank merge, so that a window takes part in a logarithmic number of merges.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import anchors, runtime

WINDOW = 100
GRAM = 24
BATCH = 1 << 19


def _words(buffer: bytes) -> np.ndarray:
    """Big-endian eight-byte word at every offset (reads past the end are padding)."""
    raw = np.frombuffer(buffer + b"\0" * 8, np.uint8)
    return np.ndarray((len(buffer) + 1,), ">u8", raw.data, 0, (1,))


class Level:
    """A text and the suffix array of its distinct windows."""

    def __init__(self, text: bytes, starts: np.ndarray, window: int):
        """starts ascending; afterwards ``first`` marks those that no equal earlier start precedes."""
        self.text, self.window = text, window
        self.view = _words(text)
        order, group = self._order(starts)
        new = np.ones(len(order), bool)
        new[1:] = group[1:] != group[:-1]
        self.first = np.zeros(len(starts), bool)
        self.first[order[new]] = True  # the order is stable, so the earliest of equals leads
        self.sa = starts[order[new]].astype(np.int32)
        self.head = self.view[self.sa].astype(np.uint64)
        self.rank = 0

    def _offsets(self) -> list[int]:
        return [*range(0, self.window - 8, 8), max(0, self.window - 8)]

    def _order(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(stable order of the windows, number of the distinct window at each place): sort by eight bytes, then only
        what is still tied by the next eight."""
        order = np.argsort(self.view[starts].astype(np.uint64), kind="stable")
        group = np.zeros(len(starts), np.int32)
        key = self.view[starts[order]].astype(np.uint64)
        group[1:] = np.cumsum(key[1:] != key[:-1])
        for o in self._offsets()[1:]:
            tied = np.zeros(len(order), bool)
            tied[1:] = group[1:] == group[:-1]
            tied[:-1] |= tied[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            key = self.view[starts[order[at]] + o].astype(np.uint64)
            sub = np.lexsort((key, group[at]))
            order[at] = order[at[sub]]
            key, g = key[sub], group[at]
            new = np.zeros(len(at), bool)
            new[1:] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
            step = np.zeros(len(order), np.int32)
            step[at] = new
            group += np.cumsum(step, dtype=np.int32)
        return order, group

    def place(self, other: "Level") -> tuple[np.ndarray, np.ndarray]:
        """A merge scan of the other's windows, in their order: which of them occur here, and before which of these the
        others belong."""
        at, there = other.sa, other.view
        lo = np.searchsorted(self.head, other.head, "left")
        hi = np.searchsorted(self.head, other.head, "right")
        found = np.zeros(len(at), bool)
        live = np.flatnonzero(lo < hi)
        while len(live):  # bisect among windows with equal heads
            mid = (lo[live] + hi[live]) // 2
            less, more = np.zeros(len(live), bool), np.zeros(len(live), bool)
            for o in self._offsets()[1:]:
                x, y = there[at[live] + o], self.view[self.sa[mid] + o]
                even = ~(less | more)
                less |= even & (x < y)
                more |= even & (x > y)
            found[live[~(less | more)]] = True
            hi[live[less]] = mid[less]
            lo[live[more]] = mid[more] + 1
            live = live[(less | more)]
            live = live[lo[live] < hi[live]]
        return found, lo

    def merged(self, other: "Level") -> "Level":
        """Both orders as one; no window of the other occurs here, so none is sorted again."""
        at = self.place(other)[1]
        both = object.__new__(Level)
        both.text, both.window, both.rank = self.text + other.text, self.window, self.rank + 1
        both.view = _words(both.text)
        both.sa = np.insert(self.sa, at, other.sa + np.int32(len(self.text)))
        both.head = np.insert(self.head, at, other.head)
        return both


class Family:
    """Levels of geometrically growing size."""

    def __init__(self, window: int):
        self.window, self.levels = window, []

    def add(self, text: bytes, starts: np.ndarray) -> np.ndarray:
        """Take a batch; for each start whether its window is new to the family and the batch."""
        level = Level(text, starts, self.window)
        old = np.zeros(len(level.sa), bool)
        for known in self.levels:
            old |= known.place(level)[0]
        new = level.first.copy()
        new[np.searchsorted(starts, level.sa[old])] = False
        level.sa, level.head = level.sa[~old], level.head[~old]
        self.levels.append(level)
        while len(self.levels) > 1 and self.levels[-2].rank <= self.levels[-1].rank:
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(a.merged(b))
        return new


def index_of(window: int, batch: int = BATCH):
    def index(texts: list[bytes], runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, offset) of the windows that start earlier in the shard, ascending."""
        family, pieces, offsets, a = Family(window), [], [], 0
        size = np.cumsum([len(t) for t in texts])
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + batch, "right")))
            lens = np.array([len(t) for t in texts[a:b]])
            piece = np.repeat(np.arange(b - a), runs[a:b])
            offset = np.arange(len(piece)) - np.repeat(np.cumsum(runs[a:b]) - runs[a:b], runs[a:b])
            old = ~family.add(b"".join(texts[a:b]), (np.cumsum(lens) - lens)[piece] + offset)
            pieces.append(piece[old] + a)
            offsets.append(offset[old])
            a = b
        return np.concatenate(pieces), np.concatenate(offsets)

    return index


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", hot_segments: int = anchors.HOT_SEGMENTS, shards: int | None = None) -> DataFrame:
    """``docs`` with ``kept`` (binary: the UTF-8 text without repeated bytes), n_bytes, n_removed, removed_spans.

    A byte goes if some string of ``window`` bytes over it also starts earlier: in a document with a smaller id, or in
    the same one.  Cuts are by byte and may split a character, so ``kept`` is binary.  Null texts are empty; a null id
    comes before all others.  Repeated rows (same id and text) stand at one place in the order and do not remove each
    other; different texts under one id are documents in the order of their hashes.  Columns of those four names are replaced, others pass
    through.  Empty input: no rows.
    """
    keyed, own = _keyed(docs, id_col, text_col)
    marks = anchors.repeats(keyed.select("_k", "_t"), _scheme(window), index_of(window), hot_segments, shards)
    return _cut(keyed, marks, own, window)


def _scheme(window: int) -> anchors.Scheme:
    if window < 8:
        raise ValueError("a window has at least eight bytes")
    return anchors.Scheme(False, window, min(GRAM, window))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    runtime.tune(docs.sparkSession)
    inner, own = runtime.plain(docs.drop("kept", "n_bytes", "n_removed", "removed_spans"))
    return runtime.order_keys(inner, *(f"_c{own.index(c)}" for c in (id_col, text_col))), own


def _cut(keyed: DataFrame, marks: DataFrame, own: list[str], window: int) -> DataFrame:
    def cutter(raw: bytes, items: np.ndarray):
        spans = anchors.removed(items, window, len(raw))
        kept = b"".join(raw[a:b] for a, b in anchors.rest(spans, len(raw))) if len(spans) else raw
        return kept, len(raw), int((spans[:, 1] - spans[:, 0]).sum()), spans.tolist()

    new = [
        T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("removed_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
    return anchors.remove(keyed, marks, cutter, new).toDF(*own, *(x.name for x in new))


class Index:
    """The family of a growing corpus, in a folder that all executors see.

    Each batch of documents comes after all before it: its ids are larger.  A level is the table of the segments that
    were new with its batches, packed by shard; the shards are fixed with the first batch.  A new batch's segments are
    merged with those of every level in their shards: equal ones are repeats, and where an anchor has others the passages
    are fetched and go through the suffix arrays.  Then the batch is the lowest level, and levels of equal rank merge, so
    that a segment takes part in a logarithmic number of merges.  Texts of earlier batches are kept for this.
    """

    def __init__(self, spark: SparkSession, folder: str, window: int = WINDOW, shards: int | None = None):
        self.spark, self.folder, self.window, self.shards = spark, folder.rstrip("/"), window, shards

    def _state(self) -> dict:
        """The newest manifest: shards, window, largest key, hot anchors, levels (rank, path), paths of texts."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.folder}/manifest")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        done = [int(n) for n in names if n.isdigit() and fs.exists(hadoop.Path(f"{self.folder}/manifest/{n}/_SUCCESS"))]
        if not done:
            return {"version": 0, "shards": self.shards or runtime.partitions(self.spark), "window": self.window, "last": None, "hot": [], "levels": [], "texts": []}
        return json.loads(self.spark.read.text(f"{self.folder}/manifest/{max(done)}").first()[0])

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``dedup`` of the batch, against itself and all batches before; the index then holds the batch."""
        spark, state = self.spark, self._state()
        if state["window"] != self.window:
            raise ValueError(f"the index has windows of {state['window']} bytes")
        keyed, own = _keyed(docs, id_col, text_col)
        keyed = runtime.stored(keyed, "batch")
        low, high = keyed.agg(F.min("_k"), F.max("_k")).first()
        if high is None:
            return _cut(keyed, spark.createDataFrame([], anchors.MARKS), own, self.window)
        if state["last"] is not None and low <= state["last"]:
            raise ValueError(f"ids of a batch must be larger than those before it; {low} is not larger than {state['last']}")
        scheme, n, path = _scheme(self.window), state["shards"], f"{self.folder}/{uuid.uuid4().hex}"
        keyed.select("_k", "_t").write.parquet(f"{path}-texts")
        if not state["version"]:
            state["hot"] = [int(x) for x in anchors.hot_anchors(keyed.select("_k", "_t"), scheme).tolist()]
        levels = [spark.read.schema(anchors.LOADS).parquet(p) for _, p in state["levels"]]
        earlier = spark.read.schema("_k long, _t string").parquet(*state["texts"]) if state["texts"] else None
        marks, fresh = anchors.repeats_against(keyed.select("_k", "_t"), earlier, levels, scheme, index_of(self.window), np.array(state["hot"], np.uint64), n, state["last"])
        fresh.write.parquet(f"{path}-level")
        state["levels"].append([0, f"{path}-level"])
        while len(state["levels"]) > 1 and state["levels"][-2][0] <= state["levels"][-1][0]:
            (_, b), (rank, a) = state["levels"].pop(), state["levels"].pop()
            joined = f"{self.folder}/{uuid.uuid4().hex}-level"
            anchors.level(spark.read.schema(anchors.LOADS).parquet(a, b), n).write.parquet(joined)
            state["levels"].append([rank + 1, joined])
        marks = runtime.stored(marks, "marks")
        state |= {"version": state["version"] + 1, "last": high, "texts": [*state["texts"], f"{path}-texts"]}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.folder}/manifest/{state['version']}")  # fails if another writer was first
        return _cut(keyed, marks, own, self.window)
