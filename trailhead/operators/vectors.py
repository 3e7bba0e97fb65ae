"""Similarity search over vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import session
from ..functions import text


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if a norm is 0.  One walk over both vectors."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    zero = F.struct(*(F.lit(0.0).alias(n) for n in ("xy", "xx", "yy")))

    def step(s: Column, p: Column) -> Column:
        return F.struct((s["xy"] + p["x"] * p["y"]).alias("xy"), (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["yy"] + p["y"] * p["y"]).alias("yy"))

    return F.aggregate(pairs, zero, step, lambda s: F.when((s["xx"] > 0) & (s["yy"] > 0), s["xy"] / (F.sqrt(s["xx"]) * F.sqrt(s["yy"]))).otherwise(0.0))


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, score) of the k nearest, best first, ties by id.  One pass; k rows a task.  Null vectors have no rows."""
    asked = vectors.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id int, query array<double>")
    named = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    return top_k_batch(named, asked, k).orderBy("rank").select(F.col("id").alias(id_col), "score")


#: Queries of one broadcast; more come in blocks, each a pass over the vectors.
QUERY_BLOCK = 8192


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _matrix(col) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(col), -1)) if len(col) else np.zeros((0, 0))


#: Vectors, and cells of a tile of scores (queries x vectors), that are looked at once: what a task holds follows neither.
_ROWS, _CELLS = 2048, 1 << 20
#: Scores count to twelve digits, so equal vectors have equal ones, whatever the tile.
_DIGITS, _SLACK = 12, 1e-11


class Best:
    """The k best (score, id) of each of n queries: most cells of a tile are under their query's k-th score and only compared."""

    def __init__(self, n: int, k: int, known: np.ndarray | None = None):
        """``known``: scores that the k-th best of each query is not under."""
        self.k, self.score, self.at, self.ids = k, np.full((n, k), -np.inf), np.zeros((n, k), np.int64), None
        self.known = np.full(n, -np.inf) if known is None else known

    def floors(self, lo: int, n: int) -> np.ndarray:
        """What a score of the n queries from ``lo`` on must reach."""
        return np.maximum(self.score[lo : lo + n, -1], self.known[lo : lo + n])

    def meet(self, lo: int, new: np.ndarray, ids: pa.Array) -> None:
        """Take in a tile: scores of the queries from ``lo`` on with the vectors ``ids``."""
        floor = self.floors(lo, len(new))
        if new.shape[1] > self.k and np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(new, -self.k, axis=1)[:, -self.k])
        query, col = np.nonzero(new >= np.maximum(floor - _SLACK, -2.0)[:, None])
        self._take(lo, len(new), query, col, new[query, col], ids)

    def take(self, lo: int, n: int, query: np.ndarray, col: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        """Take in pairs, ``query`` counted from ``lo``: of the n queries from there on with the vectors ``ids[col]``."""
        keep = score >= np.maximum(self.floors(lo, n) - _SLACK, -2.0)[query]
        self._take(lo, n, query[keep], col[keep], score[keep], ids)

    def _take(self, lo: int, n: int, query: np.ndarray, col: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        if not len(query):
            return
        k, held, score = self.k, self.score[lo : lo + n], np.round(score, _DIGITS)
        some = np.unique(query)
        old_q, old_at = np.nonzero(~np.isneginf(held[some]))
        old_q = some[old_q]
        if self.ids is None:
            names = ids.take(pa.array(col))
        else:
            old = self.at[lo + old_q, old_at]
            names = pa.concat_arrays([self.ids.take(pa.array(old)), ids.take(pa.array(col))])
        query, score = np.concatenate([old_q, query]), np.concatenate([held[old_q, old_at], score])
        place = np.empty(len(names), np.int64)
        place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        order = np.lexsort((place, -score, query))
        query, score = query[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        n = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        keep = n < k
        kept = names.take(pa.array(order[keep]))
        start = 0 if self.ids is None else len(self.ids)
        self.ids = kept if self.ids is None else pa.concat_arrays([self.ids, kept])
        self.score[lo + query[keep], n[keep]] = score[keep]
        self.at[lo + query[keep], n[keep]] = start + np.arange(len(kept))
        if len(self.ids) > 4 * self.score.size + _CELLS:  # names that nobody holds any more
            query, at = np.nonzero(~np.isneginf(self.score))
            self.ids = self.ids.take(pa.array(self.at[query, at]))
            self.at[query, at] = np.arange(len(query))

    def rows(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        query, at = np.nonzero(~np.isneginf(self.score))
        return query, self.score[query, at], self.ids.take(pa.array(self.at[query, at]))


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank): ``queries`` is a stated set (query_id, query), sent to the vectors in counted blocks.

    Scores are a matrix product of unit vectors, in tiles; a task keeps k rows a query, and only these are shuffled.  Null
    vectors have no rows.
    """
    session.ship(vectors.sparkSession)
    n = -(-queries.count() // block) or 1
    kinds = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", vectors.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    out = None
    for i in range(n):
        part = (queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)).where("query IS NOT NULL")
        sent = vectors.sparkSession.sparkContext.broadcast(part.select("query_id", "query").toArrow())  # a block at most

        def nearest(batches, sent=sent):
            asked = sent.value
            names, q = asked["query_id"].combine_chunks(), _matrix(asked["query"].combine_chunks())
            best = Best(len(q), k)
            for b in batches:
                b = b.filter(b.column("vector").is_valid())
                for at in range(0, b.num_rows if len(q) else 0, _ROWS):
                    part = b.slice(at, _ROWS)
                    m, ids = _matrix(part.column("vector")), part.column("id")
                    for lo in range(0, len(q), _CELLS // _ROWS):
                        best.meet(lo, q[lo : lo + _CELLS // _ROWS] @ m.T, ids)
            if best.ids is not None:
                query, score, ids = best.rows()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), ids, pa.array(score)], ["query_id", "id", "score"])

        best = vectors.select("id", "vector").mapInArrow(nearest, kinds)
        out = best if out is None else out.unionByName(best)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def top_k_text(docs: DataFrame, question: str, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, score) of the texts nearest to a question under the hashing embedder.

    The question's buckets are a literal map; a text's score is a sum over its own sparse counts, so one pass suffices.
    """
    spark = docs.sparkSession
    q = text.embed_sparse(spark.createDataFrame([(question,)], "q string"), "q").first().embedding
    size = sum(x.v * x.v for x in q) ** 0.5
    given = text.embed_sparse(docs.select(id_col, text_col), text_col)
    if not q:
        return given.select(id_col, F.lit(0.0).alias("score")).orderBy(id_col).limit(k)
    by = F.create_map(*(F.lit(y) for x in q for y in (x.bucket, x.v)))
    e = F.col("embedding")
    n = text.norm(e) * F.lit(size)
    dots = F.aggregate(e, F.lit(0).cast("long"), lambda s, x: s + x["v"].cast("long") * F.coalesce(by[x["bucket"]], F.lit(0)))
    return given.select(id_col, F.when(n > 0, dots / n).otherwise(0.0).alias("score")).orderBy(F.desc("score"), id_col).limit(k)
