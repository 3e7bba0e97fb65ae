"""Edit-aware token counts: a segment tree of pre-tokens for each document.

Leaves hold consecutive pre-tokens (byte length and number of ids of each); inner nodes hold the sums of both below them.
An edit is found by descending byte sums.  What is encoded anew is the text between two boundaries that the edit cannot
move: three pre-tokens before it (a match of the pattern looks ahead over white space and one code point at most, and
never back, so earlier boundaries stand), and after it the first new boundary that falls on an old one, from where on
all matches are as before.  The leaf sums and their ancestors are then updated; nothing else is touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, runtime

LEAF = 64
_CONTEXT = 3
_AHEAD = 64


class Tree:
    """Pre-token counts of one text; the text itself stays with the caller."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray):
        self.encoded = 0  # pre-tokens encoded by edits
        self._build(sizes.tolist(), counts.tolist())

    def _build(self, sizes: list[int], counts: list[int]) -> None:
        self.leaves = [(sizes[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(sizes), LEAF)] or [([], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.bytes, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (s, c) in enumerate(self.leaves):
            self.bytes[self.width + i], self.tokens[self.width + i] = sum(s), sum(c)
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.bytes[i] = self.bytes[2 * i] + self.bytes[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.bytes[1]

    def locate(self, at: int) -> tuple[int, int]:
        """(leaf, its byte offset) of the leaf that holds byte ``at``."""
        i, left = 1, 0
        while i < self.width:
            i *= 2
            if at >= left + self.bytes[i] and self.bytes[i + 1]:
                left += self.bytes[i]
                i += 1
        return i - self.width, left

    def before(self, at: int) -> int:
        """Tokens of the pre-tokens that end at or before byte ``at``."""
        leaf, left = self.locate(at)
        i, total = leaf + self.width, 0
        while i > 1:
            if i & 1:
                total += self.tokens[i - 1]
            i //= 2
        for s, c in zip(*self.leaves[leaf]):
            if left + s > at:
                break
            left, total = left + s, total + c
        return total

    def _replace(self, first: int, last: int, sizes: list[int], counts: list[int]) -> None:
        """The pre-tokens of leaves first..last become the given ones."""
        if len(sizes) > 4 * LEAF * (last - first + 1):  # grown too much: rebuild
            self.leaves[first : last + 1] = [(sizes, counts)]
            flat = [[x for leaf in self.leaves for x in leaf[j]] for j in (0, 1)]
            self._build(*flat)
            return
        n = last - first + 1
        step = -(-len(sizes) // n) or 1
        for k in range(n):
            self.leaves[first + k] = sizes[k * step : (k + 1) * step], counts[k * step : (k + 1) * step]
            i = first + k + self.width
            self.bytes[i], self.tokens[i] = sum(self.leaves[first + k][0]), sum(self.leaves[first + k][1])
        i, j = (first + self.width) // 2, (last + self.width) // 2
        while i:
            for x in range(i, j + 1):
                self._sum(x)
            i, j = i // 2, j // 2

    def edit(self, encoder: bpe.Encoder, text: bytes, at: int, removed: int, new: bytes) -> bytes:
        """Replace ``removed`` bytes at ``at`` (both on character boundaries) and return the new text."""
        return lockstep([self.steps(encoder, text, at, removed, new)])[0]

    def steps(self, encoder: bpe.Encoder, text: bytes, at: int, removed: int, new: bytes):
        """The edit as a generator: it yields a piece of text, is sent the piece's boundaries, and returns the new text.
        So the pieces of many documents are pre-tokenised in one go."""
        out = text[:at] + new + text[at + removed :]
        if not out or not text:
            self._rebuild(encoder, out)
            return out
        first, left = self.locate(at)
        cuts, n_before = self._cuts(first, left, first), 0
        while first and sum(c <= at for c in cuts) <= _CONTEXT:
            first -= 1
            left -= self.bytes[first + self.width]
            cuts = self._cuts(first, left, first) + cuts[1:]
        n_before = max(0, sum(c <= at for c in cuts) - 1 - _CONTEXT)
        start = cuts[n_before]
        shift, ahead = len(new) - removed, _AHEAD
        while True:
            stop = min(len(out), at + len(new) + ahead)
            while stop < len(out) and out[stop] & 0xC0 == 0x80:
                stop += 1
            last, _ = self.locate(min(max(0, stop - shift), max(0, self.length - 1)))
            last = max(first, last)
            old = self._cuts(first, left, last)
            ends = {c + shift for c in old if c >= at + removed}
            bounds = (yield out[start:stop]) + start
            # a boundary is certain if two more follow it, or the text ends
            sure = bounds if stop == len(out) else bounds[: -_CONTEXT]
            meet = next((int(b) for b in sure if b >= at + len(new) and b > start and int(b) in ends), None)
            if meet is None and stop == len(out):
                meet = len(out)
            if meet is not None:
                break
            ahead *= 4
        bounds = bounds[: int(np.searchsorted(bounds, meet)) + 1]
        toks = encoder.tokens(out[start:meet], bounds - start)
        self.encoded += len(toks)
        sizes = [x for leaf in self.leaves[first : last + 1] for x in leaf[0]]
        counts = [x for leaf in self.leaves[first : last + 1] for x in leaf[1]]
        j = int(np.searchsorted(old, meet - shift))
        self._replace(first, last, sizes[:n_before] + np.diff(bounds).tolist() + sizes[j:], counts[:n_before] + [len(t) for t in toks] + counts[j:])
        return out

    def _cuts(self, first: int, left: int, last: int) -> list[int]:
        """Boundaries of the pre-tokens in leaves first..last, from byte ``left``."""
        cuts = [left]
        for leaf in self.leaves[first : last + 1]:
            for s in leaf[0]:
                cuts.append(cuts[-1] + s)
        return cuts

    def _rebuild(self, encoder: bpe.Encoder, text: bytes) -> None:
        fresh = of_text(encoder, text)
        fresh.encoded = self.encoded + sum(len(s) for s, _ in fresh.leaves)
        self.__dict__ = fresh.__dict__


def lockstep(jobs: list) -> list:
    """Run edit generators side by side; each round pre-tokenises all their pieces at once."""
    done, sent = [None] * len(jobs), [None] * len(jobs)
    live = list(range(len(jobs)))
    while live:
        asked, pieces = [], []
        for i in live:
            try:
                pieces.append(jobs[i].send(sent[i]))
                asked.append(i)
            except StopIteration as end:
                done[i] = end.value
        if asked:
            off = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
            bounds, first = bpe.boundaries(np.frombuffer(b"".join(pieces), np.uint8), off)
            for i, a, b, o, e in zip(asked, first[:-1].tolist(), first[1:].tolist(), off[:-1], off[1:]):
                sent[i] = np.append(bounds[a:b], e) - o
        live = asked
    return done


def of_text(encoder: bpe.Encoder, text: bytes) -> Tree:
    data = np.frombuffer(text, np.uint8)
    bounds = bpe.boundaries(data, np.array([0, len(data)]))[0]
    return Tree(np.diff(bounds), np.array([len(t) for t in encoder.tokens(text, bounds)], np.int64))


#: A kept tree: the leaves in order; the inner sums follow from them.
TREE = T.StructType([T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])


def _trees(enc: bpe.Encoder, data: np.ndarray, off: np.ndarray) -> tuple[list[Tree], list[bytes], np.ndarray]:
    """(tree and text of each document, their numbers of pre-tokens)."""
    raw = data.tobytes()
    bounds, first = bpe.boundaries(data, off)
    counts, sizes = enc.ids(raw, bounds)[0], np.diff(bounds)
    trees = [Tree(sizes[p:q], counts[p:q]) for p, q in zip(first[:-1], first[1:])]
    return trees, [raw[p:q] for p, q in zip(off[:-1], off[1:])], np.diff(first)


def _edited(enc: bpe.Encoder, trees: list[Tree], texts: list[bytes], edits: list) -> list[bytes]:
    """The texts after their edits; the trees follow.  The k-th edits of all documents are pre-tokenised together."""
    texts = list(texts)
    for k in range(max((len(e or ()) for e in edits), default=0)):
        due = [j for j, e in enumerate(edits) if len(e or ()) > k and e[k] is not None]
        jobs = [in_points(trees[j], enc, texts[j], **{x: edits[j][k][x] for x in ("at", "removed", "text")}) for j in due]
        for j, t in zip(due, lockstep(jobs)):
            texts[j] = t
    return texts


def _column(trees: list[Tree]) -> pa.Array:
    flat = [[[x for leaf in t.leaves for x in leaf[j]] for t in trees] for j in (0, 1)]
    return pa.StructArray.from_arrays([pa.array(f, pa.list_(pa.int32())) for f in flat], ["sizes", "counts"])


def grow(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``tree`` (see ``TREE``) and n_tokens: the table to keep beside a corpus that changes.

    Null texts have empty trees; columns with the new names are replaced; bytes that are no UTF-8 are read as U+FFFD.
    """
    spark = docs.sparkSession
    runtime.tune(spark)
    src = docs.drop("tree", "n_tokens")
    shared, keep = bpe.Vocabulary(spark, vocabulary), src.columns

    def f(batches):
        enc = bpe.encoder(shared)
        for batch in batches:
            data, off = runtime.texts_of(batch.column(text_col))
            for a, b in runtime.pieces(off, 1 << 20):
                trees = _trees(enc, data[off[a] : off[b]], off[a : b + 1] - off[a])[0]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in keep), _column(trees), pa.array([t.total for t in trees], pa.int64())], [*keep, "tree", "n_tokens"])

    return src.mapInArrow(f, T.StructType([*src.schema.fields, T.StructField("tree", TREE), T.StructField("n_tokens", T.LongType())]))


def edit(grown: DataFrame, vocabulary: str, edits_col: str, text_col: str = "text") -> DataFrame:
    """``grown`` after the edits in ``edits_col`` (as in ``count``): text, tree and n_tokens as they are then, and
    n_reencoded, the pre-tokens that were encoded for it.  Nothing else of a text is; a row without edits is not read.

    A tree whose sizes do not add up to its text raises.
    """
    spark = grown.sparkSession
    runtime.tune(spark)
    src = grown.drop("n_reencoded")
    shared, names = bpe.Vocabulary(spark, vocabulary), src.columns

    def f(batches):
        enc = bpe.encoder(shared)
        for batch in batches:
            data, off = runtime.texts_of(batch.column(text_col))
            raw, kept = data.tobytes(), batch.column("tree").to_pylist()
            for a, b in runtime.pieces(off, 1 << 20):
                trees = [Tree(*(np.array((t or {}).get(x) or [], np.int64) for x in ("sizes", "counts"))) for t in kept[a:b]]
                if any(t.length != q - p for t, p, q in zip(trees, off[a:b], off[a + 1 : b + 1])):
                    raise ValueError("tree and text do not belong together")
                texts = _edited(enc, trees, [raw[p:q] for p, q in zip(off[a:b], off[a + 1 : b + 1])], batch.column(edits_col).slice(a, b - a).to_pylist())
                new = {text_col: pa.array([t.decode() for t in texts], pa.string()), "tree": _column(trees), "n_tokens": pa.array([t.total for t in trees], pa.int64())}
                cols = [new[c] if c in new else batch.column(c).slice(a, b - a) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([t.encoded for t in trees], pa.int64())], [*names, "n_reencoded"])

    return src.mapInArrow(f, T.StructType([*src.schema.fields, T.StructField("n_reencoded", T.LongType())]))


def count(docs: DataFrame, vocabulary: str, text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, n_pretokens and, after the edits, edited_n_tokens, n_reencoded, edited_text.

    ``edits_col``: array<struct<at:int, removed:int, text:string>> in code points of the text at that time, applied in
    order; a position beyond the end is the end, a null edit or a null array does nothing, null text is empty, and bytes
    that are no UTF-8 are read as U+FFFD.  Map only, ``grow`` and ``edit`` in one pass.  Columns with the new names are
    replaced, others pass through; repeated rows are counted each.  Empty input: no rows.
    """
    spark = docs.sparkSession
    runtime.tune(spark)
    new = [("n_tokens", T.LongType()), ("n_pretokens", T.LongType()), ("edited_n_tokens", T.LongType()), ("n_reencoded", T.LongType()), ("edited_text", T.StringType())]
    src = docs.drop(*(n for n, _ in new))
    shared, keep = bpe.Vocabulary(spark, vocabulary), src.columns

    def f(batches):
        enc = bpe.encoder(shared)
        for batch in batches:
            data, off = runtime.texts_of(batch.column(text_col))
            edits = batch.column(edits_col).to_pylist() if edits_col else [None] * batch.num_rows
            rows = []
            for a, b in runtime.pieces(off, 1 << 20):
                trees, texts, n = _trees(enc, data[off[a] : off[b]], off[a : b + 1] - off[a])
                before = [t.total for t in trees]
                texts = _edited(enc, trees, texts, edits[a:b])
                rows += [(n, q, t.total, t.encoded, x.decode()) for n, q, t, x in zip(before, n.tolist(), trees, texts)]
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int64()] * 4, pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*keep, *(n for n, _ in new)])

    return src.mapInArrow(f, T.StructType([*src.schema.fields, *(T.StructField(n, t) for n, t in new)]))


def in_points(tree: Tree, encoder: bpe.Encoder, content: bytes, at: int | None, removed: int | None, text: str | None):
    """An edit in code points, as a generator for ``lockstep``."""
    at, removed = max(0, at or 0), max(0, removed or 0)
    starts = np.flatnonzero((np.frombuffer(content, np.uint8) & 0xC0) != 0x80)
    a, b = (int(starts[k]) if k < len(starts) else len(content) for k in (at, at + removed))
    return tree.steps(encoder, content, a, b - a, (text or "").encode("utf-8", "surrogatepass"))


def apply(tree: Tree, encoder: bpe.Encoder, content: bytes, at: int, removed: int, new: str) -> bytes:
    """One edit in code points; the new text."""
    return lockstep([in_points(tree, encoder, content, at, removed, new)])[0]


def proof_edits(text: str = "text"):
    """Three edits as an editor would make them: a word put in at a third, eight code points cut at the middle, and a
    contraction with white space before it put in at two thirds."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    edit = lambda at, removed, new: F.struct(at.cast("int").alias("at"), F.lit(removed).alias("removed"), F.lit(new).alias("text"))
    return F.array(edit(F.floor(n / 3), 0, " edited"), edit(F.floor(n / 2), 8, ""), edit(F.floor(n * 2 / 3), 0, " \n\nit's 42"))
