"""Quality classifier: a linear-chain conditional random field over lines.

Every line is good or bad.  Its features are shares of character classes and of repeated words, for the line itself and
its neighbours; transitions tie adjacent lines.  Training lines take their document's label.  A document's quality is the
mean of its lines' forward-backward marginals, weighted by length, and a logistic curve fitted on the training documents
makes it a probability.

The model is fitted on a bounded sample of labelled rows: the ``SAMPLE_DOCS`` labelled training documents with the smallest
hashes of their ids.  Of a document of more than ``SAMPLE_LINES`` lines, runs of ``RUN`` lines are drawn over the whole text,
as many as make that number.  All three are parameters of ``train``.  Scoring is map only and takes every line of every
document; a long text goes in parts, and what stays of a line is two numbers.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashes, runtime

SAMPLE_DOCS = 3000
SAMPLE_LINES = 200
RUN = 25
THRESHOLD = 0.3
FOLDS = 5
#: Texts are taken together up to about so many bytes; a longer one goes in parts of that size.
LONG = 1 << 18
#: Lines of a chunk, and chunks that are worked on together.
CHUNK, GROUP = 256, 512
#: Character classes: bytes of each; the last class is the rest.
_SETS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0)), b".", b",", b"!?", b"$%&#*^~+=<>@\\_`", b"|", b"\"'()[]{}-:;/"]
_TAIL = 5  # continuation bytes are no characters
_CLASS = np.full(256, len(_SETS), np.int64)
for _i, _s in enumerate(_SETS):
    _CLASS[list(_s)] = _i
_N = len(_SETS) + 1
OWN = _N - 1 + 5


def _starts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, document, whether it has bytes) of each line; a text without any is one empty line."""
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.union1d(breaks, off[:-1])  # documents of no text get their line below
    starts = starts[starts < off[-1]] if len(data) else starts[:0]
    empty = np.flatnonzero(np.diff(off) == 0)
    begin = np.concatenate([starts, off[empty]])
    owner = np.concatenate([np.searchsorted(off, starts, "right") - 1, empty])
    order = np.lexsort((begin, owner))
    full = np.concatenate([np.ones(len(starts), bool), np.zeros(len(empty), bool)])[order]
    return begin[order], owner[order], full


def _sums(data: np.ndarray, off: np.ndarray, begin: np.ndarray, full: np.ndarray):
    """(bytes of each class, words, words like the one before, distinct words) of each line, and each word's (line, hash)."""
    n = len(begin)
    line = np.repeat(np.flatnonzero(full), np.diff(np.append(begin[full], len(data))))
    counts = np.bincount(line * _N + _CLASS[data], minlength=n * _N).reshape(n, _N).astype(np.float64)
    low = hashes.LOWER[data]
    s, e, _ = hashes.word_spans(low, off, hashes.NOT_SPACE)
    words = line[s] if len(s) else np.zeros(0, np.int64)
    h = hashes.span_hashes(low, s, e)
    same = np.zeros(len(s), bool)
    same[1:] = (h[1:] == h[:-1]) & (words[1:] == words[:-1])
    pair = np.lexsort((h, words))
    fresh = np.ones(len(s), bool)
    fresh[1:] = (h[pair][1:] != h[pair][:-1]) | (words[pair][1:] != words[pair][:-1])
    return counts, np.bincount(words, minlength=n), np.bincount(words, same, n), np.bincount(words[pair], fresh, n), words, h


def _long(data: np.ndarray):
    """The sums of a long text's lines, a part at a time; a part's first line goes on with the one that the last left open."""
    held = None  # an open line's sums, distinct words and last word
    for a, b, _ in runtime.parts(data, hashes.NOT_SPACE, 0, LONG):
        off = np.array([0, b - a])
        begin, _, full = _starts(data[a:b], off)
        *sums, words, h = _sums(data[a:b], off, begin, full)
        first, final = h[words == 0], h[words == len(begin) - 1]
        known, before = np.unique(first), None
        if held is not None:
            old, known, before = held
            sums[2][0] += len(first) > 0 and first[0] == before
            known = np.union1d(known, first)
            for x, y in zip(sums, old):
                x[0] += y
            sums[3][0] = len(known)
        if len(begin) > 1:
            known, before = np.unique(final), None
        if data[b - 1] == 10:
            yield sums
            held = None
        else:
            held = [x[-1].copy() for x in sums], known, final[-1] if len(final) else before
            yield [x[:-1] for x in sums]
    if held is not None:
        yield [x[None] for x in held[0]]


def _own(counts: np.ndarray, n_words: np.ndarray, same: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a line's own features, its characters)."""
    chars = counts.sum(1) - counts[:, _TAIL]
    w = np.maximum(n_words, 1)
    own = np.empty((len(counts), OWN))
    own[:, : _N - 1] = np.delete(counts, _TAIL, 1) / np.maximum(chars, 1)[:, None]
    own[:, _N - 1] = same / w
    own[:, _N] = 1 - distinct / w
    own[:, _N + 1] = np.log1p(chars) / 8
    own[:, _N + 2] = chars / w / 10
    own[:, _N + 3] = n_words == 0
    return own, chars


def blocks(data: np.ndarray, off: np.ndarray):
    """(own features, characters, lines of each document or None) of texts whose bytes are together about LONG.

    One longer text comes as several blocks of its lines, without the lines' number.
    """
    if len(off) == 2 and len(data) > LONG:
        for sums in _long(data):
            yield *_own(*sums), None
    else:
        begin, owner, full = _starts(data, off)
        sums = _sums(data, off, begin, full)[:4]
        yield *_own(*sums), np.bincount(owner, minlength=len(off) - 1)


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line with its neighbours', characters of each line, first line of each document), all at once."""
    got = list(blocks(data, off))
    own, chars = (np.concatenate([g[i] for g in got]) for i in (0, 1))
    lines = np.array([len(own)]) if got[0][2] is None else got[0][2]
    first = np.concatenate([[0], np.cumsum(lines)])
    head, tail = np.zeros(len(own), bool), np.zeros(len(own), bool)
    head[first[:-1]] = True
    tail[first[1:] - 1] = True
    before = np.where(head[:, None], 0, np.roll(own, 1, 0))
    after = np.where(tail[:, None], 0, np.roll(own, -1, 0))
    return np.hstack([own, before, after, head[:, None], tail[:, None], np.ones((len(own), 1))]), chars, first


def n_lines(data: np.ndarray) -> int:
    """Lines of one text; a text without bytes is one."""
    return int(np.count_nonzero(data == 10)) + (not len(data) or data[-1] != 10)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray  # log transition scores [from, to], 1 = good
    curve: tuple[float, float] = (0.0, 1.0)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights, -30, 30)

    def parts(self) -> tuple[np.ndarray, np.ndarray, float]:
        """The same as three weights of a line's own features (for itself, the next and the last line), of a document's first
        and last line, and a constant."""
        w = self.weights / self.scale
        return w[: 3 * OWN].reshape(3, OWN).T, w[3 * OWN : 3 * OWN + 2], float(w[-1] - self.mean @ w)


def marginals(emission: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good) of each line, expected transitions, log partition function of each document), all documents at once."""
    n, lens = len(emission), np.diff(first)
    order = np.argsort(-lens, kind="stable")
    lens, start = lens[order], first[:-1][order]
    e = np.stack([np.ones(n), np.exp(emission)], 1)
    a, m = np.exp(moves), int(lens[0]) if len(lens) else 0
    alpha, beta, z = np.empty((n, 2)), np.ones((n, 2)), np.zeros(len(lens))
    for t in range(m):
        at = start[: np.searchsorted(-lens, -t, "left")] + t
        v = e[at] if not t else (alpha[at - 1] @ a) * e[at]
        s = v.sum(1)
        alpha[at] = v / s[:, None]
        z[: len(at)] += np.log(s)
    moved = np.zeros((2, 2))
    for t in range(m - 2, -1, -1):
        at = start[: np.searchsorted(-lens, -(t + 1), "left")] + t
        v = e[at + 1] * beta[at + 1]
        b = v @ a.T
        pair = alpha[at][:, :, None] * a * v[:, None, :]
        moved += (pair / pair.sum((1, 2))[:, None, None]).sum(0)
        beta[at] = b / b.sum(1)[:, None]
    p = alpha * beta
    out = np.empty(len(lens))
    out[order] = z
    return p[:, 1] / p.sum(1), moved, out


def fit(x: np.ndarray, chars: np.ndarray, first: np.ndarray, label: np.ndarray, docs: np.ndarray | None = None, rounds: int = 150, ridge: float = 1e-3) -> Model:
    """Maximum likelihood by Adam; then the logistic curve from document quality to label.

    ``first`` are the runs of lines, ``label`` a run's label, and ``docs`` (default: each run) the first run of each document.
    """
    docs = np.arange(len(first)) if docs is None else docs
    lens = np.diff(first)
    y = np.repeat(label, lens).astype(float)
    scale = x.std(0)
    scale[scale < 1e-6] = 1
    mean = x.mean(0)
    mean[-1], scale[-1] = 0, 1
    model = Model(mean, scale, np.zeros(x.shape[1]), np.zeros((2, 2)))
    xs, n = (x - mean) / scale, max(1, len(x))
    told = np.zeros((2, 2))
    for k in (0, 1):
        told[k, k] = (lens[label == k] - 1).sum()
    m1 = m2 = np.zeros(x.shape[1] + 4)
    for t in range(1, rounds + 1):
        p, moved, _ = marginals(model.emissions(x), first, model.moves)
        g = np.concatenate([xs.T @ (y - p), (told - moved).reshape(-1)]) / n - ridge * np.concatenate([model.weights, model.moves.reshape(-1)])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        model.weights = model.weights + step[:-4]
        model.moves = model.moves + step[-4:].reshape(2, 2)
    q = quality(marginals(model.emissions(x), first, model.moves)[0], chars, first[docs])
    label = label[docs[:-1]]
    a, b = 0.0, 0.0
    for _ in range(50):  # Newton with a small ridge
        p = 1 / (1 + np.exp(-(a + b * (q - 0.5))))
        w, d = p * (1 - p) + 1e-9, label - p
        h = np.array([[w.sum() + 0.1, (w * (q - 0.5)).sum()], [(w * (q - 0.5)).sum(), (w * (q - 0.5) ** 2).sum() + 0.1]])
        da, db = np.linalg.solve(h, [d.sum() - 0.1 * a, (d * (q - 0.5)).sum() - 0.1 * b])
        a, b = a + np.clip(da, -2, 2), b + np.clip(db, -4, 4)
    model.curve = (float(a), float(b))
    return model


def good(emission: np.ndarray, first: np.ndarray, moves: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """P(good) of each line, as ``marginals`` gives it, in steps that a long document does not lengthen.

    Documents are cut into chunks.  A chunk's transfer matrix is the product of its lines' 2 x 2 matrices, all chunks at once;
    a walk over a document's chunks gives the vectors before and behind each; with these the chunks are independent.
    """
    a = np.exp(moves)
    n_chunks = np.maximum(1, -(-np.diff(first) // chunk))
    at = np.concatenate([[0], np.cumsum(n_chunks)])
    start = np.repeat(first[:-1], n_chunks) + chunk * (np.arange(at[-1]) - np.repeat(at[:-1], n_chunks))
    lens = np.minimum(chunk, np.repeat(first[1:], n_chunks) - start)
    into, behind = np.ones((len(start), 2)), np.ones((len(start), 2))
    many = np.flatnonzero(n_chunks > 1)
    for d in many:
        p, q = int(at[d]), int(at[d + 1])
        m = np.concatenate([_transfer(emission, start[i : min(i + GROUP, q)], lens[i : min(i + GROUP, q)], a) for i in range(p, q, GROUP)])
        u = np.ones(2)
        for c in range(p, q - 1):
            u = u @ m[c - p] @ a
            into[c + 1] = u = u / u.sum()
        w = np.ones(2)
        for c in range(q - 2, p - 1, -1):
            w = a @ (m[c + 1 - p] @ w)
            behind[c] = w = w / w.sum()
    out = np.empty(len(emission))
    for i in range(0, len(start), GROUP):
        _inside(emission, start[i : i + GROUP], lens[i : i + GROUP], into[i : i + GROUP], behind[i : i + GROUP], a, out)
    return out


def _transfer(emission, start, lens, a) -> np.ndarray:
    """Product of the lines' matrices of each chunk, scaled: from the vector into its first line to that behind its last."""
    m = np.zeros((len(start), 2, 2))
    m[:, 0, 0], m[:, 1, 1] = 1, np.exp(emission[start])
    order = np.argsort(-lens, kind="stable")
    for t in range(1, int(lens.max())):
        k = order[: np.searchsorted(-lens[order], -t, "left")]
        v = m[k] @ a
        v[:, :, 1] *= np.exp(emission[start[k] + t])[:, None]
        m[k] = v / v.sum((1, 2))[:, None, None]
    return m


def _inside(emission, start, lens, into, behind, a, out) -> None:
    """Fill ``out`` with P(good) of the chunks' lines from the vectors before and behind them."""
    order = np.argsort(-lens, kind="stable")
    start, lens, v, w = start[order], lens[order], into[order], behind[order].copy()
    size = int(lens.max()) if len(lens) else 0
    alpha = np.empty((size, len(start), 2))
    active = [int(np.searchsorted(-lens, -t, "left")) for t in range(size + 1)]
    for t in range(size):
        k = active[t]
        v = v[:k] @ a if t else v[:k].copy()
        v[:, 1] *= np.exp(emission[start[:k] + t])
        v /= v.sum(1)[:, None]
        alpha[t, :k] = v
    for t in range(size - 1, -1, -1):
        k, on = active[t], active[t + 1]  # ``on`` chunks have a line behind this one
        b = w[:on].copy()
        b[:, 1] *= np.exp(emission[start[:on] + t + 1]) if on else 1
        b = b @ a.T
        w[:on] = b / b.sum(1)[:, None]
        p = alpha[t, :k] * w[:k]
        out[start[:k] + t] = p[:, 1] / p.sum(1)


def quality(p: np.ndarray, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals ``p``."""
    w = chars + 1.0
    return np.add.reduceat(w * p, first[:-1]) / np.add.reduceat(w, first[:-1]) if len(first) > 1 else np.zeros(0)


def texts_quality(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Quality of each text (their bytes are together about LONG, or there is one); a long one's lines are numbers only."""
    w, ends, constant = model.parts()
    total = n_lines(data) if len(off) == 2 else None
    at, emission, chars, lines = 0, None, None, None
    for own, c, lines in blocks(data, off):
        if emission is None:
            size = len(own) if total is None else total
            emission, chars = np.full(size, constant), np.empty(size, np.int32 if total and total > CHUNK else np.int64)
        n, p = len(own), own @ w
        if not n:
            continue
        emission[at : at + n] += p[:, 0]
        emission[at + 1 : at + n + 1] += p[: max(0, size - at - 1), 1]  # what a line adds to the next one's
        emission[max(0, at - 1) : at + n - 1] += p[0 if at else 1 :, 2]
        chars[at : at + n] = c
        if lines is not None:  # several documents: nothing passes between them
            first = np.concatenate([[0], np.cumsum(lines)])
            edge = first[1:-1]
            emission[edge] -= p[edge - 1, 1]
            emission[edge - 1] -= p[edge, 2]
        at += n
    if lines is None:
        first = np.array([0, size])
    emission[first[:-1]] += ends[0]
    emission[first[1:] - 1] += ends[1]
    np.clip(emission, -30, 30, out=emission)
    return quality(good(emission, first, model.moves), chars, first)


def held_out(id_col) -> F.Column:
    """The ids that training never sees; a null id is none of them."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def sampled(data: np.ndarray, most: int, run: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, characters, lines of each run) of a text's lines: all, or runs from over the whole text beyond ``most``."""
    total = n_lines(data)
    if total <= most:
        cuts = [(0, total)]
    else:
        run = min(run, most)
        n = most // run
        stretch = [total * i // n for i in range(n + 1)]
        cuts = [(p + seed % (q - p - run + 1), run) for p, q in zip(stretch[:-1], stretch[1:])]
    wanted = np.unique(np.concatenate([np.arange(max(0, p - 1), min(total, p + n + 1)) for p, n in cuts]))
    at, own, chars = 0, np.zeros((len(wanted), OWN)), np.zeros(len(wanted))
    for block, c, _ in blocks(data, np.array([0, len(data)])):
        a, b = np.searchsorted(wanted, [at, at + len(block)])
        own[a:b], chars[a:b] = block[wanted[a:b] - at], c[wanted[a:b] - at]
        at += len(block)
    out, kept = [], []
    for p, n in cuts:
        i = np.searchsorted(wanted, np.arange(p, p + n))
        before, after = np.roll(own, 1, 0)[i], np.roll(own, -1, 0)[i]
        ends = np.zeros((n, 2))
        if p == 0:
            before[0], ends[0, 0] = 0, 1
        if p + n == total:
            after[-1], ends[-1, 1] = 0, 1
        out.append(np.hstack([own[i], before, after, ends, np.ones((n, 1))]))
        kept.append(chars[i])
    return np.concatenate(out), np.concatenate(kept), np.array([n for _, n in cuts])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES, run: int = RUN) -> Model:
    """A model from ``labels`` (id, label 0 or 1; null labels and ids do not count) and their texts in ``docs``.

    It is fitted on at most ``sample_docs`` labelled documents, by the hash of their ids.  One of more than ``sample_lines``
    lines is cut into as many equal stretches as it has runs of ``run`` lines to give, and gives one from each, at a place
    that the id's hash names; no document and no part of a text is left out for its length.
    Of several texts under one id the one with the least hash counts.  Without both labels in the sample the model is
    neutral: every score is the share of label 1 (0.5 without labels).
    """
    runtime.tune(docs.sparkSession)
    told = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    some = told.orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)  # bounded, so it may be broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), runtime.text_key(id_col, text_col)[1]).join(F.broadcast(some), "_id")
    texts = texts.groupBy("_id", "_y").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t"))

    def f(batches):
        for batch in batches:
            data, off = runtime.bytes_of(batch.column("_t"))
            rows = []
            for k, (i, y) in enumerate(zip(batch.column("_id").to_pylist(), batch.column("_y").to_pylist())):
                x, chars, sizes = sampled(data[off[k] : off[k + 1]], sample_lines, run, zlib.crc32(str(i).encode()))
                rows.append((i, y, x.tobytes(), chars.tobytes(), sizes.astype(np.int64).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["id", "y", "x", "c", "n"])

    rows = texts.mapInArrow(f, "id long, y int, x binary, c binary, n binary").collect()  # features of the bounded sample
    rows.sort(key=lambda r: (r.id, r.x))
    width = 3 * OWN + 3
    label = np.array([r.y for r in rows], np.int64)
    if len(set(label)) < 2:
        rate = (label.sum() + 1) / (len(label) + 2)
        return Model(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), (float(np.log(rate / (1 - rate))), 0.0))
    x = np.concatenate([np.frombuffer(r.x).reshape(-1, width) for r in rows])
    runs = [np.frombuffer(r.n, np.int64) for r in rows]
    first = np.concatenate([[0], np.cumsum(np.concatenate(runs))])
    docs = np.concatenate([[0], np.cumsum([len(n) for n in runs])])
    return fit(x, np.concatenate([np.frombuffer(r.c) for r in rows]), first, np.repeat(label, np.diff(docs)), docs)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1); map only.

    Only the text matters.  A null or empty text is one empty line.  A column called score is replaced, all others pass
    through; repeated rows are scored each.  Empty input: no rows.
    """
    spark = docs.sparkSession
    runtime.tune(spark)
    src = docs.drop("score")
    shared = spark.sparkContext.broadcast(model)  # a few hundred numbers

    def f(batches):
        m = shared.value
        for batch in batches:
            data, off = runtime.texts_of(batch.column(text_col))
            out = []
            for a, b in runtime.pieces(off, LONG):
                q = texts_quality(m, data[off[a] : off[b]], off[a : b + 1] - off[a])
                out.append(1 / (1 + np.exp(-(m.curve[0] + m.curve[1] * (q - 0.5)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], [*batch.schema.names, "score"])

    return src.mapInArrow(f, T.StructType([*src.schema.fields, T.StructField("score", T.DoubleType())]))
