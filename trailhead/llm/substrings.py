"""Substring dedup: repeated runs of words by a compressed FM-index for each shard.

``anchors`` deals windows of words out to shards by content and fetches the distinct passages that may share a window.
Each shard indexes its passages and then streams them through the index in document order: backward search over the
wavelet tree gives, for every position, the matching statistics up to the window's length; where they reach it, the
suffix interval holds all places of the window, and the window is repeated if its interval was met before.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import anchors, hashes, runtime
from .fm_index import FMIndex

WINDOW = 20
GRAM = 5
_AT_ONCE = 1 << 17


def index_of(window: int):
    def index(texts: list[bytes], runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, offset) of the windows that start earlier in the shard, ascending."""
        ids: dict[bytes, int] = {}
        words = [[ids.setdefault(w, len(ids) + 2) for w in t.split()] + [1] for t in texts]
        lens = np.array([len(w) for w in words])
        text = np.zeros(lens.sum() + 1, np.int64)
        text[:-1] = np.concatenate(words)
        fm = FMIndex(text)
        begin = np.cumsum(lens) - lens
        piece = np.repeat(np.arange(len(texts)), runs)
        offset = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        start = begin[piece] + offset
        found, met = np.zeros(len(start), bool), np.zeros(fm.n, bool)
        for a in range(0, len(start), _AT_ONCE):
            s = start[a : a + _AT_ONCE]
            got, lo, _ = fm.matching(text, s + window, window, least=2)
            full = np.flatnonzero(got == window)
            found[a + full] = True
            at, earliest = np.unique(lo[full], return_index=True)  # a window's interval is known by where it begins
            found[a + full[earliest[~met[at]]]] = False
            met[at] = True
        return piece[found], offset[found]

    return index


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", hot_segments: int = anchors.HOT_SEGMENTS, shards: int | None = None) -> DataFrame:
    """``docs`` with ``kept`` (the text without repeated words), n_words, n_removed and removed_spans (word ranges).

    A word goes if some window of ``window`` words over it also starts earlier: in a document with a smaller id, or in
    the same one.  Words are separated by ASCII white space; kept runs of words keep the white space inside them and are
    joined by one space.  A text that loses nothing is unchanged.  Null texts are empty and have no words; a null id
    comes before all others.  Repeated rows (same id and text) stand at one place in the order and do not remove each
    other; different texts under one id are documents in the order of their hashes.  Columns of those four names are replaced, others pass
    through.  Empty input: no rows.
    """
    runtime.tune(docs.sparkSession)
    names = ("kept", "n_words", "n_removed", "removed_spans")
    src = docs.drop(*names)
    inner, own = runtime.plain(src)
    keyed = runtime.order_keys(inner, *(f"_c{own.index(c)}" for c in (id_col, text_col)))
    scheme = anchors.Scheme(True, window, min(GRAM, window))
    marks = anchors.repeats(keyed.select("_k", "_t"), scheme, index_of(window), hot_segments, shards)

    def cutter(raw: bytes, items: np.ndarray):
        data = np.frombuffer(raw, np.uint8)
        s, e, _ = hashes.word_spans(data, np.array([0, len(data)]), hashes.NOT_SPACE)
        spans = anchors.removed(items, window, len(s))
        if not len(spans):
            return raw.decode("utf-8", "replace"), len(s), 0, []
        kept = b" ".join(raw[s[a] : e[b - 1]] for a, b in anchors.rest(spans, len(s)))
        return kept.decode("utf-8", "replace"), len(s), int((spans[:, 1] - spans[:, 0]).sum()), spans.tolist()

    new = [
        T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("removed_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
    return anchors.remove(keyed, marks, cutter, new).toDF(*own, *(x.name for x in new))
