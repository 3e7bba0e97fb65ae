"""Exact top-k over inverted buckets, without reading most of them.

``index`` cuts sparse embeddings into segments of some hundred texts.  A segment lists, for each bucket, its texts by falling
weight, and beside that each text's own buckets.  ``search`` keeps the k best scores of every question; the k-th is a floor.
A question's heaviest buckets, until what is left of its norm is under the floor, are the only ones where a text that
matters must occur: if these lists are short, their texts are scored.  A question whose heaviest lists are long meets all
texts of a segment: many questions at once in a matrix product of single precision, and what comes to the floor, with room
for that product's error, is scored in double precision.  Nothing is approximate: a text is left out only if its score
cannot reach the k-th best.

Segments are rows, so any number of tasks search them, each with the question's floor from a first look at a few of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import schema, session
from . import vectors

#: Texts of a segment; one segment in so many gives the first floor.
SEGMENT, FIRST = 512, 16
#: Questions of one broadcast (each some 10 KB in a task); a block is a pass over the segments.
QUERY_BLOCK = 16384
#: Questions that meet a segment at once, pairs that are scored at once, rows of a batch that a task returns, and cells of a
#: matrix product that cost as much as one entry of a text that is found by a list.
AT_ONCE, PAIRS, OUT, ENTRY = 1024, 4096, 1 << 16, 64
#: What a search reads of a segment.
READ = ("cuts", "texts", "own_cuts", "own", "own_weights")
#: What a product of unit vectors in single precision is off by at most, for each bucket (two roundings of 2^-24 and as much again).
_EPS, _HALF = 1e-9, 2.0**-22


def _rows(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of the entries of array<struct<bucket, v>>; weights make a unit vector.  Null rows are empty."""
    lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy()
    items = col.flatten()
    row = np.repeat(np.arange(len(col)), lens)
    bucket, v = items.field("bucket").to_numpy(zero_copy_only=False).astype(np.int64), items.field("v").to_numpy(zero_copy_only=False).astype(np.float64)
    norm = np.sqrt(np.bincount(row, v * v, len(col)))
    return row, bucket, v / norm[row]


def index(texts: DataFrame, size: int = SEGMENT, dim: int = schema.DIM) -> DataFrame:
    """Segments of ``texts`` (id, embedding: array of (bucket, v)); write them once and search them often.

    A row: the ids, and packed arrays: by bucket (list bounds, texts, falling weights), by text (bounds, buckets, weights).
    """
    session.ship(texts.sparkSession)
    kind = T.StructType([T.StructField("segment", T.LongType()), T.StructField("ids", T.ArrayType(texts.schema["id"].dataType)), *(T.StructField(c, T.BinaryType()) for c in ("cuts", "texts", "weights", "own_cuts", "own", "own_weights"))])

    def f(batches):
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                row, bucket, w = _rows(part.column("embedding"))
                order = np.lexsort((-w, bucket))
                cuts = np.searchsorted(bucket[order], np.arange(dim + 1))
                own = np.searchsorted(row, np.arange(part.num_rows + 1))
                packed = [cuts.astype("<i4"), row[order].astype("<i4"), w[order], own.astype("<i4"), bucket.astype("<i4"), w]
                ids = part.column("id")
                number = int.from_bytes(hashlib.blake2b(str(ids[0]).encode(), digest_size=8).digest(), "little", signed=True)
                lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([pa.array([number]), lists, *(pa.array([x.tobytes()]) for x in packed)], kind.fieldNames())

    return session.spread(texts.select("id", "embedding")).mapInArrow(f, kind)


class Segment:
    """A segment as one matrix of its texts' weights; a bucket's column is its list."""

    def __init__(self, row: dict, dim: int):
        self.cuts, self.texts, own_cuts = (np.frombuffer(row[c], "<i4") for c in ("cuts", "texts", "own_cuts"))
        self.lens, self.own = np.diff(self.cuts), np.diff(own_cuts)
        self.w = np.zeros((len(own_cuts) - 1, dim))
        self.w[np.repeat(np.arange(len(self.w)), self.own), np.frombuffer(row["own"], "<i4")] = np.frombuffer(row["own_weights"])
        self.half = self.w.astype(np.float32)


class Questions:
    """Unit vectors of questions with their buckets by falling weight, and what is left of the norm from a place on."""

    def __init__(self, q: np.ndarray):
        self.q, self.half, self.slack = q, q.astype(np.float32), q.shape[1] * _HALF
        self.place, self.left = np.empty(q.shape, np.int16), np.zeros((len(q), q.shape[1] + 1))
        for lo in range(0, len(q), AT_ONCE):
            part = q[lo : lo + AT_ONCE]
            order = np.argsort(-np.abs(part), axis=1, kind="stable")
            np.put_along_axis(self.place[lo : lo + AT_ONCE], order, np.arange(q.shape[1], dtype=np.int16)[None], axis=1)
            rest = np.cumsum(np.take_along_axis(part, order, 1)[:, ::-1] ** 2, axis=1)[:, ::-1]
            self.left[lo : lo + AT_ONCE, :-1] = np.sqrt(np.maximum(0, rest))

    def search(self, seg: Segment, lo: int, hi: int, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(question, counted from ``lo``; text; score, exact; postings read) of the questions ``lo`` to ``hi`` with the
        segment's texts: every pair that reaches its question's floor and is among the segment's k best, and maybe others."""
        q, n = self.half[lo:hi], np.argmax(self.left[lo:hi] < (floor - _EPS)[:, None], axis=1)
        n[floor <= _EPS] = q.shape[1]
        heavy = self.place[lo:hi] < n[:, None]
        lists = heavy.astype(np.float32) @ seg.lens.astype(np.float32)
        whole = (lists * seg.own.mean() * ENTRY > seg.w.size) | (floor <= _EPS)
        full, few = np.flatnonzero(whole), np.flatnonzero(~whole)
        who, text, read = [], [], len(full) * int(seg.lens.sum()) + int(lists[few].sum())
        if full.size:
            near = (q if len(full) == len(q) else q[full]) @ seg.half.T
            least = floor[full]
            if near.shape[1] > k and np.isneginf(least).any():
                least = np.maximum(least, np.partition(near, -k, axis=1)[:, -k] - self.slack)
            w, x = np.divmod(np.flatnonzero(near >= (least - self.slack).astype(np.float32)[:, None]), near.shape[1])
            who.append(full[w]), text.append(x)
        if few.size:
            w, bucket = np.nonzero(heavy[few])
            n = seg.lens[bucket]
            x = seg.texts[np.repeat(seg.cuts[bucket] + n - np.cumsum(n), n) + np.arange(n.sum())]
            w, x = np.divmod(np.unique(np.repeat(w, n) * len(seg.own) + x), len(seg.own))
            read += int(seg.own[x].sum())
            who.append(few[w]), text.append(x)
        who, text = np.concatenate([*who, []]).astype(np.int64), np.concatenate([*text, []]).astype(np.int64)
        score = np.empty(len(who))
        for at in range(0, len(who), PAIRS):
            score[at : at + PAIRS] = np.einsum("ij,ij->i", self.q[lo + who[at : at + PAIRS]], seg.w[text[at : at + PAIRS]])
        return who, text, score, read


def _best(segments: DataFrame, asked: pa.Table, floors: dict, k: int, dim: int) -> DataFrame:
    """(query_id, id, score, read, total): each task's k best a question, and a row without a question that counts postings."""
    spark = segments.sparkSession
    sent = spark.sparkContext.broadcast((asked, floors))
    id_kind = segments.schema["ids"].dataType.elementType
    kind = T.StructType([T.StructField("query_id", _kind_of(asked, spark)), T.StructField("id", id_kind), T.StructField("score", T.DoubleType()), T.StructField("read", T.LongType()), T.StructField("total", T.LongType())])

    def f(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        asked, floors = sent.value
        names = asked["query_id"].combine_chunks()
        row, bucket, w = _rows(asked["embedding"].combine_chunks())
        q = np.zeros((len(names), dim))
        q[row, bucket] = w
        questions, best = Questions(q), vectors.Best(len(q), k, np.array([floors.get(name, -np.inf) for name in names.to_pylist()]))
        read = total = 0
        for b in batches:
            for n in range(b.num_rows):
                seg = Segment({c: b.column(c)[n].as_py() for c in READ}, dim)
                ids = b.column("ids")[n].values
                total += int(seg.lens.sum()) * len(names)
                for lo in range(0, len(names), AT_ONCE):
                    hi = min(lo + AT_ONCE, len(names))
                    who, text, score, n_read = questions.search(seg, lo, hi, best.floors(lo, hi - lo), k)
                    read += n_read
                    best.take(lo, hi - lo, who, text, score, ids)
        types = [to_arrow_type(x.dataType) for x in kind.fields]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, None, read, total), types)], kind.fieldNames())
        if best.ids is not None:
            who, score, ids = best.rows()
            for at in range(0, len(who), OUT):
                found = [names.take(pa.array(who[at : at + OUT])), ids.slice(at, OUT), pa.array(score[at : at + OUT])]
                yield pa.RecordBatch.from_arrays([*(x.cast(t) for x, t in zip(found, types)), *(pa.nulls(len(found[0]), t) for t in types[3:])], kind.fieldNames())

    return segments.select("ids", *READ).mapInArrow(f, kind)


def _kind_of(table: pa.Table, spark) -> T.DataType:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(table.schema.field("query_id").type)


def search(segments: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK, dim: int = schema.DIM) -> tuple[DataFrame, DataFrame]:
    """((query_id, id, score, rank), (read, total)): the k best of ``segments`` for each of ``queries`` (query_id, embedding), exact,
    ties by id; and how many postings were read of how many there are, over all questions.

    ``queries`` is a stated set, sent in counted blocks.  Fewer texts than k: all.  A question without words scores 0.
    """
    session.ship(segments.sparkSession)
    n = -(-queries.count() // block) or 1
    out, cores = None, segments.sparkSession.sparkContext.defaultParallelism
    first = session.checkpointed(segments.where(F.pmod("segment", F.lit(FIRST)) == 0).coalesce(cores))  # each task returns k rows a question
    for i in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)
        asked = part.select("query_id", "embedding").toArrow()  # a block at most
        look = _best(first, asked, {}, k, dim).where("query_id IS NOT NULL")
        place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        floors = {r["query_id"]: r["score"] for r in look.withColumn("n", F.row_number().over(place)).where(F.col("n") == k).collect()}  # a number a question
        got = _best(segments, asked, floors, k, dim)
        out = got if out is None else out.unionByName(got)
    out = session.checkpointed(out)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = out.where("query_id IS NOT NULL").select("query_id", "id", "score").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return best, out.agg(F.coalesce(F.sum("read"), F.lit(0)).alias("read"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
