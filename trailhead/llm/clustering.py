"""Centroid clustering: exact k-means over integer vectors, with Drake's adaptive bounds.

Each vector keeps an upper bound on the distance to its centroid, lower bounds on those to the ``b`` next nearest, and one
remainder bound on all others.  Centroids move, bounds loosen by their drift; where the upper bound stays under a lower
one, the order behind that is certain and only the centroids before it are measured again, exactly, in integers.  ``b``
starts at a quarter of the centroids and shrinks to what the last round needed, an eighth at least.

Bounds lie in a table beside the vectors, with the round they belong to.  A round is one map over it and sums of a few
hundred numbers a task; the table is written anew only when a tenth of the vectors had to be measured, since bounds can be
loosened by the drift of several rounds as well.  Centroids (k rows) are all that the driver holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Components of at most this size have distances that fit 64 bits (up to 128 components); of at most _SMALL, that are
#: exact in doubles too.
LIMIT, _SMALL = 1 << 27, 1 << 22
#: Share of measured vectors beyond which a round's bounds are written.
REWRITE = 0.1
#: Bounds are widened by this much, so that rounding never certifies what is not so.
_SLACK = 1e-9
#: In place of a level: every centroid was measured.
ALL = 1 << 20

STATE = "_i long, _x binary, _a int, _u double, _near binary, _low binary"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(_i, _x): id and floor(scale * component) as packed integers, of the vectors with exactly ``dim`` finite components.

    A null vector, another length, a null or non-finite component: no row.  Repeated rows and null ids stay.  A scaled
    component beyond 2^27 is an error, since its distances do not fit a long.
    """
    spark = vectors.sparkSession
    runtime.tune(spark)
    src = vectors.select(F.col(id_col).cast("long").alias("_i"), F.col(vector_col).cast("array<double>").alias("_v"))

    def f(batches):
        for b in batches:
            b = b.filter(pc.equal(pc.fill_null(pc.list_value_length(b.column("_v")), -1), dim))
            if not b.num_rows:
                continue
            flat = b.column("_v").flatten()
            # a null becomes not-a-number, so one test covers both
            x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
            good = np.isfinite(x).all(1)
            with np.errstate(over="ignore"):
                x = np.floor(x[good] * scale)
            if len(x) and np.abs(x).max() > LIMIT:
                raise ValueError(f"a component beyond {LIMIT / scale:g} has distances that do not fit 64 bits")
            yield pa.RecordBatch.from_arrays([b.column("_i").filter(pa.array(good)), packed(x.astype("<i4"))], ["_i", "_x"])

    return src.mapInArrow(f, "_i long, _x binary")


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as binary values."""
    raw = np.ascontiguousarray(rows)
    off = np.arange(len(raw) + 1, dtype=np.int32) * (raw.shape[1] * raw.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(off), pa.py_buffer(raw)])


def unpacked(col: pa.Array, kind: str) -> np.ndarray:
    data, off = runtime.bytes_of(col)
    return np.frombuffer(data.tobytes(), kind).reshape(len(off) - 1, -1) if len(off) > 1 else np.zeros((0, 0), kind)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows x to all centroids."""
    if not len(x):
        return np.zeros((0, len(c)), np.int64)
    if max(np.abs(x).max(), np.abs(c).max()) <= _SMALL:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x.astype(np.int64) - y) ** 2).sum(1) for y in c.astype(np.int64)], 1)


def picked(x: np.ndarray, c: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to its own few centroids (rows x m)."""
    out = np.empty(which.shape, np.int64)
    for z in range(which.shape[1]):
        d = x.astype(np.int64) - c[which[:, z]]
        out[:, z] = np.einsum("ij,ij->i", d, d)
    return out


@dataclass
class Round:
    """What every task of a round knows: k rows of numbers."""

    centroids: np.ndarray
    drift: np.ndarray | None  # how far each centroid is from where the stored bounds saw it; None: there are none
    b: int


def _ordered(d: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of a row's centroids, nearest first, equal distances by number."""
    return np.lexsort((which, d), axis=1)


def _full(x: np.ndarray, r: Round) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(centroid, upper bound, the next nearest, lower bounds with the remainder's) from all distances."""
    k = len(r.centroids)
    d = squares(x, r.centroids)
    names = np.broadcast_to(np.arange(k), d.shape)
    order = _ordered(d, names)
    far = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    near, low = order[:, 1 : r.b + 1], np.full((len(x), r.b + 1), np.inf)
    low[:, : near.shape[1]] = far[:, 1 : r.b + 1]
    if k > r.b + 1:
        low[:, r.b] = far[:, r.b + 1]
    return order[:, 0], far[:, 0], near, low


def assign(x: np.ndarray, a: np.ndarray, u: np.ndarray, near: np.ndarray, low: np.ndarray, r: Round):
    """The state of rows after the centroids moved, and how many levels had to be measured (0: none).

    Levels: behind a lower bound above the upper one the order is certain.
    """
    b = near.shape[1]
    u = (u + r.drift[a]) * (1 + _SLACK)
    low = low.copy()
    low[:, :b] = (low[:, :b] - r.drift[near]) * (1 - _SLACK)
    low[:, b] = (low[:, b] - (r.drift.max() if len(r.drift) else 0)) * (1 - _SLACK)
    a, near = a.copy(), near.copy()
    ahead = np.minimum.accumulate(low[:, ::-1], 1)[:, ::-1]  # the least bound from a level on

    def level(rows, top):
        sure = top[:, None] < ahead[rows]
        return np.where(sure.any(1), sure.argmax(1), ALL)

    every = np.arange(len(x))
    need = level(every, u)
    loose = np.flatnonzero(need)
    if len(loose):  # the own distance first: it often certifies the order as it is
        u[loose] = np.sqrt(picked(x[loose], r.centroids, a[loose, None])[:, 0].astype(np.float64)) * (1 + _SLACK)
        need[loose] = level(loose, u[loose])
    for z in range(1, b + 1):
        at = np.flatnonzero(need == z)
        if not len(at):
            continue
        which = np.concatenate([a[at, None], near[at, :z]], 1)
        d = picked(x[at], r.centroids, which)
        order = _ordered(d, which)
        which, far = np.take_along_axis(which, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        a[at], u[at], near[at, :z], low[at, :z] = which[:, 0], far[:, 0], which[:, 1:], far[:, 1:]
    at = np.flatnonzero(need == ALL)
    if len(at):
        a[at], u[at], names, bounds = _full(x[at], Round(r.centroids, None, b))
        near[at], low[at] = names, bounds
    return a, u, near, low, need


def _state(batch: pa.RecordBatch, r: Round):
    """(x, centroid, upper bound, next nearest, lower bounds, measured levels) of a batch in this round."""
    x = unpacked(batch.column("_x"), "<i4")
    if r.drift is None:
        return x, *_full(x, r), np.full(len(x), ALL)
    near, low = unpacked(batch.column("_near"), "<i4"), unpacked(batch.column("_low"), "<f8")
    a, u = batch.column("_a").to_numpy(), batch.column("_u").to_numpy()
    a, u, near, low, need = assign(x, a.astype(np.int64), u, near.astype(np.int64), low, r)
    if r.b < near.shape[1]:  # the levels that are given up go into the remainder
        near, low = near[:, : r.b], np.concatenate([low[:, : r.b], low[:, r.b :].min(1, keepdims=True)], 1)
    return x, a, u, near, low, need


def _sums(state: DataFrame, r: Round) -> tuple[np.ndarray, list, int, int]:
    """(vectors a cluster, sums a cluster, measured vectors, deepest measured level): one map, small sums from each task."""
    sent = state.sparkSession.sparkContext.broadcast(r)
    k, width = r.centroids.shape

    def f(batches):
        r = sent.value
        total, deep, measured = np.zeros((k, width + 1), np.int64), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, a, *_, need = _state(batch, r)
            for c in np.unique(a):
                mine = x[a == c]
                total[c, 0] += len(mine)
                total[c, 1:] += mine.sum(0, dtype=np.int64)
            measured += int((need > 0).sum())
            part = need[(need > 0) & (need < ALL)]
            deep = max(deep, int(part.max()) if len(part) else 0)
        key, at = np.nonzero(total)
        told = [[-1, -2], [measured, deep]]
        rows = [np.append(key * (width + 1) + at, told[0]), np.append(total[key, at], told[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in rows], ["key", "n"])

    cells = state.mapInArrow(f, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("top")).collect()  # k x (width + 1)
    total, told = np.zeros((k, width + 1), object), {-1: 0, -2: 0}
    for c in cells:
        if c.key >= 0:
            total[c.key // (width + 1), c.key % (width + 1)] = c.n
        else:
            told[c.key] = c.top if c.key == -2 else c.n
    return total[:, 0], total[:, 1:], told[-1], told[-2]


def _written(state: DataFrame, r: Round, path: str) -> DataFrame:
    sent = state.sparkSession.sparkContext.broadcast(r)

    def f(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            _, a, u, near, low, _ = _state(batch, sent.value)
            columns = [batch.column("_i"), batch.column("_x"), pa.array(a.astype(np.int32)), pa.array(u), packed(near.astype("<i4")), packed(low.astype("<f8"))]
            yield pa.RecordBatch.from_arrays(columns, ["_i", "_x", "_a", "_u", "_near", "_low"])

    return runtime.stored_at(state.mapInArrow(f, STATE), path)


def starts(kept: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors of the k smallest hashes of ``seed:id``; equal ids: by components.  A null id has no hash and comes last."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_i").cast("string")), 256)
    rows = kept.select(name.alias("h"), "_x").orderBy(F.asc_nulls_last("h"), "_x").limit(k).collect()  # k rows
    return np.stack([np.frombuffer(bytes(r["_x"]), "<i4") for r in rows]).astype(np.int64) if rows else np.zeros((0, 0), np.int64)


def cluster(kept: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((_i, cluster, distance) of ``quantised`` vectors, the final centroids).

    Fewer vectors than k: as many centroids.  Ties go to the smaller number; a centroid without vectors stays where it is.
    No vectors: no rows.
    """
    spark = kept.sparkSession
    path = runtime.work_path(spark, "vectors")
    state = runtime.stored_at(kept, path)
    now = starts(state, k, seed)
    k = len(now)
    if not k:
        return state.select("_i", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), now
    least = min(k - 1, max(1, k // 8))
    b = max(least, min(k - 1, -(-k // 4)))
    seen = None  # the centroids that the stored bounds were made for

    def told() -> Round:
        drift = None if seen is None else np.sqrt(np.array([sum(int(v) ** 2 for v in d) for d in now - seen], np.float64)) * (1 + _SLACK)
        return Round(now, drift, b)

    for _ in range(rounds):
        counts, sums, measured, deep = _sums(state, told())
        if measured > REWRITE * sum(counts):
            if seen is not None:
                b = max(least, min(b, deep))
            old, path = path, runtime.work_path(spark, "bounds")
            state, seen = _written(state, told(), path), now
            runtime.drop(spark, old)  # the new table holds all of it
        now = np.array([[int(v) // int(n) for v in s] if n else list(c) for n, s, c in zip(counts, sums, now)], np.int64).reshape(k, -1)
    last = spark.sparkContext.broadcast(told())

    def f(batches):
        for batch in batches:
            if batch.num_rows:
                x, a, *_ = _state(batch, last.value)
                d = picked(x, last.value.centroids, a[:, None])[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column("_i"), pa.array(a.astype(np.int32)), pa.array(d)], ["_i", "cluster", "distance"])

    return runtime.stored(state.mapInArrow(f, "_i long, cluster int, distance long"), "clusters"), now


def report(placed: DataFrame, centroids: np.ndarray, id_col: str = "vec_id") -> DataFrame:
    """``placed`` with each cluster's and the whole inertia and the final centroid (array), a row a vector.  An inertia that
    does not fit a long is an error."""
    sums = {r["cluster"]: r["n"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # k rows
    rows = [(i, [int(v) for v in c], sums[i], sum(sums.values())) for i, c in enumerate(centroids) if i in sums]
    known = placed.sparkSession.createDataFrame(rows, "cluster int, centroid array<long>, cluster_inertia long, inertia long")
    return placed.withColumnRenamed("_i", id_col).join(F.broadcast(known), "cluster")
