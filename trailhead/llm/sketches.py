"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct hashes of a text's shingles of five words (lower-cased ASCII; words between ASCII
white space; a shorter text is one shingle).  The k smallest of a union come from the parts' k smallest, so sketches of
parts merge into the sketch of the whole.  Two sketches estimate resemblance (Jaccard), containment and the number of
distinct shingles; with fewer than k shingles all are exact.

Stored form: hexadecimal digits, 16 for each hash, ascending; no shingle: the empty string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import hashes, runtime

K = 128
SHINGLE = 5
_BYTES = 1 << 20
LONG = runtime.LONG


def sketches(texts: list[bytes], k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each text: sorted uint64."""
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    out = []
    for a, b in runtime.pieces(off, _BYTES):
        if b == a + 1 and off[b] - off[a] > LONG:
            out.append(_long(data[off[a] : off[b]], k, shingle))
            continue
        low = hashes.LOWER[data[off[a] : off[b]]]
        s, e, first = hashes.word_spans(low, off[a : b + 1] - off[a], hashes.NOT_SPACE)
        x = hashes.span_hashes(low, s, e)
        g = hashes.grams(x, shingle)
        for p, q in zip(first[:-1].tolist(), first[1:].tolist()):
            if q - p >= shingle:
                h = g[p : q - shingle + 1]
                if len(h) > 4 * k:  # the smallest few, with room for repeats
                    h = _smallest(h, k)
                out.append(np.unique(h)[:k])
            else:
                out.append(hashes.grams(x[p:q], q - p) if q > p else np.zeros(0, np.uint64))
    return out


def _long(data: np.ndarray, k: int, shingle: int) -> np.ndarray:
    """The sketch of a long text, merged from its parts; a part repeats the last words of the one before."""
    got, words = np.zeros(0, np.uint64), 0
    for a, b, repeats in runtime.parts(data, hashes.NOT_SPACE, shingle - 1, LONG):
        low = hashes.LOWER[data[a:b]]
        s, e, _ = hashes.word_spans(low, np.array([0, b - a]), hashes.NOT_SPACE)
        got = np.union1d(got, hashes.grams(hashes.span_hashes(low, s, e), shingle))[:k]
        words += len(s) - repeats
    if words >= shingle:
        return got
    low = hashes.LOWER[data]
    s, e, _ = hashes.word_spans(low, np.array([0, len(data)]), hashes.NOT_SPACE)
    return hashes.grams(hashes.span_hashes(low, s, e), words) if words else got


def _smallest(h: np.ndarray, k: int) -> np.ndarray:
    n = 2 * k
    while n < len(h):
        part = np.partition(h, n - 1)[:n]
        if len(np.unique(part)) >= k:
            return part
        n *= 4
    return h


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness of the shingle sets; two empty sets are alike."""
    low = merge(a, b, k)
    if not len(low):
        return 1.0
    return len(np.intersect1d(np.intersect1d(a, b, True), low, True)) / len(low)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; an empty a is contained."""
    if not len(a):
        return 1.0
    common = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, common / distinct(a, k))


def to_text(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def from_text(s: str | None) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s or ""), ">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, text_col: str = "text", k: int = K) -> DataFrame:
    """``docs`` with ``fingerprint`` and ``n_shingles`` (estimated); map only.  Null texts have the empty fingerprint."""
    runtime.tune(docs.sparkSession)
    src = docs.drop("fingerprint", "n_shingles")
    keep = src.columns

    def f(batches):
        for batch in batches:
            data, off = runtime.texts_of(batch.column(text_col))
            raw = data.tobytes()
            got = sketches([raw[s:e] for s, e in zip(off[:-1], off[1:])], k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([to_text(x) for x in got]), pa.array([distinct(x, k) for x in got])], [*keep, "fingerprint", "n_shingles"])

    return src.mapInArrow(f, T.StructType([*src.schema.fields, T.StructField("fingerprint", T.StringType()), T.StructField("n_shingles", T.DoubleType())]))


def merged(prints: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """One fingerprint for each group of rows: the k smallest hashes of all parts' fingerprints.

    A group of any size is cut by the hash value into 64 parts; each keeps its k smallest before they meet.
    """
    h = F.explode(F.expr("transform(sequence(1, length(fingerprint) div 16), i -> substring(fingerprint, 16 * i - 15, 16))"))
    hashed = prints.where("length(fingerprint) >= 16").select(*by, h.alias("h")).distinct()
    part = Window.partitionBy(*by, F.pmod(F.xxhash64("h"), F.lit(64))).orderBy("h")
    few = hashed.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= k)
    full = few.groupBy(*by).agg(F.array_join(F.slice(F.array_sort(F.collect_list("h")), 1, k), "").alias("fingerprint"))
    return prints.select(*by).distinct().join(full, by, "left").withColumn("fingerprint", F.coalesce("fingerprint", F.lit("")))


def edited(text: str, following: str) -> str:
    """The last half of the text's code points give way to the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range_of(col: str, cuts: list[int]) -> Column:
    """How many cuts are not below the value.  Two steps, so the work of a row grows with the root of their number."""
    if not cuts:
        return F.lit(0)
    down = sorted(cuts, reverse=True)
    step = max(1, int(len(down) ** 0.5))
    blocks = [down[i : i + step] for i in range(0, len(down), step)]
    longs = lambda x: F.array(*(F.lit(c).cast("long") for c in x))
    whole = F.size(F.filter(longs(b[-1] for b in blocks), lambda c: c >= F.col(col)))
    inside = F.size(F.filter(F.get(F.array(*(longs(b) for b in blocks)), whole), lambda c: c >= F.col(col)))
    return F.least(whole * step + F.when(whole < len(blocks), inside).otherwise(0), F.lit(len(down)))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, n_shingles_with_next double, held_by_next double"


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Each document against its edited text and the next document in descending id (after the last: the first).

    ``near_…``: estimated resemblance; ``n_shingles``: distinct shingles of the text, and of both texts by their merged
    sketches; ``held_by_next``: the share of the text's shingles that the next one has too.

    Ids are cut into ranges by quantiles, as many as shuffle partitions.  A range needs one text more, the first of the
    range below: the ids of these firsts, one a range, are looked up, and their rows go to both ranges.  So texts are
    shuffled once and no task sees more than its range.  Null ids come last, null texts are empty; rows of one id come
    in the order of their texts.  Empty input: no rows.
    """
    spark = docs.sparkSession
    runtime.tune(spark)
    n = runtime.partitions(spark)
    low = -(2**63)
    base = docs.select(*runtime.text_key(id_col, text_col), F.col(id_col).cast("long").alias("_id"))
    cuts = base.agg(F.percentile_approx("_k", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted({int(c) for c in cuts})
    placed = base.withColumn("part", _range_of("_k", cuts).cast("int"))  # part 0 has the largest ids
    tops = {r.part: r.m for r in placed.groupBy("part").agg(F.max("_k").alias("m")).collect()}  # one row a range
    used = sorted(tops)
    borrow = [(tops[q], p) for p, q in zip(used, used[1:] + used[:1])]
    given = spark.createDataFrame(borrow or [(low, 0)], "_k long, part int")
    # of the rows with a range's first id, the one with the least text
    lent = base.join(F.broadcast(given), "_k").groupBy("part").agg(F.min("_t").alias("_t"))
    rows = placed.select("part", F.lit(0).alias("tail"), "_k", "_id", "_t").unionByName(
        lent.select("part", F.lit(1).alias("tail"), F.lit(low).alias("_k"), F.lit(None).cast("long").alias("_id"), "_t")
    )
    ordered = rows.repartitionById(n, "part").sortWithinPartitions("part", "tail", F.desc("_k"), "_t")

    def f(batches):
        before = None  # (part, id, text, sketch) that waits for its next
        for batch in batches:
            data, off = runtime.bytes_of(batch.column("_t"))
            raw = data.tobytes()
            texts = [raw[s:e] for s, e in zip(off[:-1], off[1:])]
            parts, tails, ids = (batch.column(c).to_pylist() for c in ("part", "tail", "_id"))
            prints = sketches(texts, k)
            made, todo = [], []
            for p, tail, i, t, h in zip(parts, tails, ids, texts, prints):
                if before and before[0] == p:
                    todo.append((before, t, h))
                before = None if tail else (p, i, t, h)
            done = [edited(b[2].decode("utf-8", "surrogatepass"), t.decode("utf-8", "surrogatepass")).encode("utf-8", "surrogatepass") for b, t, _ in todo]
            for (b, _, h), e, s in zip(todo, done, sketches(done, k)):
                made.append((b[1], len(b[2].decode("utf-8", "surrogatepass")), hashlib.sha256(e).hexdigest(), to_text(b[3]), to_text(s), resemblance(b[3], s, k), resemblance(b[3], h, k), distinct(b[3], k), distinct(merge(b[3], h, k), k), containment(b[3], h, k)))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), _TYPES)], _NAMES)

    out = ordered.mapInArrow(f, _OUT)
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out


_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in _OUT.split(", ")]
