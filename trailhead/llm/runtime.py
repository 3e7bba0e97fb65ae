"""What the operators share: session settings, shared storage, tables, arrow helpers.

Every path that outlives a task is below ``spark.checkpoint.dir``, the folder that driver and executors share.
"""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

#: Rows of an arrow batch; texts can be long, so batches stay small.
ROWS_PER_BATCH = 512


shared_dir, ship = session.shared_dir, session.ship


def _steady_heap() -> None:
    """Freed arrays of a megabyte or more go back to the system at once; else a worker that has met one large text keeps
    its memory, beside the JVM's, for as long as it lives.  Where the C library has no such setting, nothing changes."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 22)  # M_TRIM_THRESHOLD


_steady_heap()


def tune(spark: SparkSession) -> None:
    """The package on every worker, and small arrow batches, since a batch holds whole texts.

    The size of a batch is a setting of the session and is read when a plan runs, so it stays set.
    """
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def work_path(spark: SparkSession, name: str) -> str:
    return f"{session.work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: lineage ends here and a lost executor loses nothing."""
    return stored_at(df, work_path(df.sparkSession, name))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """``stored`` at a path of the caller's, who may ``drop`` it."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """An intermediate table that nothing reads any more goes before the application ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; a small one is dealt over all cores, since its file may be a single split."""
    return session.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Hadoop's names of stores that pyarrow knows by another one.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "gcs": "gs"}


def fs_of(uri: str):
    """(filesystem, path) for an executor: local files directly, other stores by pyarrow's connectors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")


def text(name: str):
    """A column as text: null is empty, and bytes that are no UTF-8 (a file may hold some) are replaced by U+FFFD."""
    return F.make_valid_utf8(F.coalesce(F.col(name).cast("string"), F.lit("")))


def text_key(id_col: str, text_col: str) -> list:
    """Internal columns: ``_k`` orders documents (null ids first), ``_t`` is the text (see ``text``)."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("_k"), text(text_col).alias("_t")]


#: A key of more rows than this, and than a 50,000th of all, is looked up by broadcast: 50,000 rows at most.
HOT_ROWS = 256
#: Up to so many short rows are few enough to broadcast the whole other side, which has no more.
PLAIN_ROWS = 1 << 16


def lookup(big: DataFrame, small: DataFrame, key: str, count: str, rows: int, how: str = "inner", plain: int | None = None) -> DataFrame:
    """``big`` (of ``rows`` rows) joined with ``small``, which has a row a key and the number of big's rows that have it.

    Hot keys go to the rows, the others by shuffle, so that no task gets a hot key's rows.  Up to ``plain`` rows (by
    default ``PLAIN_ROWS``; 0 where a side's rows are long) all keys go to the rows.  ``count`` is dropped.
    """
    if rows <= (PLAIN_ROWS if plain is None else plain):
        return big.join(F.broadcast(small.drop(count)), key, how)
    least = max(HOT_ROWS, rows // 50_000)
    hot = small.where(F.col(count) > least).drop(count).withColumn("_hot", F.lit(True))
    met = big.join(F.broadcast(hot), key, "left")
    rest = met.where("_hot IS NULL").select(*big.columns).join(small.where(F.col(count) <= least).drop(count), key, how)
    return met.where("_hot").drop("_hot").unionByName(rest)


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string or binary column; null is empty.  offsets start at 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
        if col.null_count:
            col = col.fill_null("")
    else:
        col = col.cast(pa.large_binary())
        if col.null_count:
            col = col.fill_null(b"")
    n = len(col)
    _, off, data = col.buffers()
    o = np.frombuffer(off, dtype=np.int64, count=n + 1 + col.offset)[col.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def texts_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``bytes_of`` a text column; bytes that are no UTF-8 are replaced by U+FFFD, as ``text`` does in a plan."""
    data, off = bytes_of(col)
    try:
        data.tobytes().decode()
        return data, off
    except UnicodeDecodeError:
        raw = data.tobytes()
        good = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(off[:-1], off[1:])]
        return np.frombuffer(b"".join(good), np.uint8), np.concatenate([[0], np.cumsum([len(g) for g in good])]).astype(np.int64)


#: A text of more bytes is worked through in parts, so that its memory is that of a part and of the result.
LONG = 8 << 20


def parts(data: np.ndarray, table: np.ndarray, overlap: int, size: int):
    """Ranges (a, b, repeats) of a text, each with about ``size`` bytes more than the last.  They end between words (table: bytes of words) or at
    the end; each begins with the last ``overlap`` words of the one before, or as many (``repeats``) as that has."""
    a = b = repeats = 0
    while True:
        b = min(len(data), b + size)  # every part has new bytes, however few words the last one had
        while b < len(data) and table[data[b]]:
            b += 1
        yield a, b, repeats
        if b == len(data):
            return
        back, s = b, np.zeros(0, np.int64)
        while len(s) <= overlap and back > a:
            back = max(a, b - max(4096, 4 * (b - back)))
            while back > a and table[data[back]]:
                back -= 1
            w = table[data[back:b]]
            s = np.flatnonzero(w & ~np.concatenate([[False], w[:-1]]))
        repeats = min(overlap, len(s))
        a = back + int(s[-repeats]) if repeats else b


def pieces(offsets: np.ndarray, size: int):
    """Row ranges (a, b) whose bytes are about ``size``; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def plain(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns called _c0, _c1, …, so that no name of ours clashes, and their own names."""
    return df.toDF(*(f"_c{i}" for i in range(len(df.columns)))), df.columns


def order_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with _k and _t; equal _k only for rows that repeat both id and text.

    _k is the id, unless several texts share one (or have none): then it is the rank by id and the text's hash, made by a
    range sort and the partitions' counts.
    """
    spark = docs.sparkSession
    base = docs.select(*text_key(id_col, text_col), *(F.col(f"`{c}`") for c in docs.columns))
    many = base.groupBy("_k").agg(F.min(F.xxhash64("_t")).alias("a"), F.max(F.xxhash64("_t")).alias("b")).where("a <> b")
    if many.isEmpty():
        return base
    n = partitions(spark)
    pairs = base.select("_k", F.xxhash64("_t").alias("_h")).distinct().repartitionByRange(n, "_k", "_h").sortWithinPartitions("_k", "_h")

    def number(batches):
        i = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(i, i + b.num_rows))], ["_k", "_h", "_p", "_i"])
            i += b.num_rows

    placed = stored(pairs.select("_k", "_h", F.spark_partition_id().alias("_p")).mapInArrow(number, "_k long, _h long, _p int, _i long"), "keys")
    sizes = sorted((r["_p"], r["count"]) for r in placed.groupBy("_p").count().collect())  # a row a partition
    at, total = {}, 0
    for p, c in sizes:
        at[p], total = total, total + c
    first = F.create_map(*(F.lit(x) for p in at for x in (p, at[p])))
    ranks = placed.select(F.col("_k").alias("_rk"), F.col("_h").alias("_rh"), (first[F.col("_p")] + F.col("_i")).alias("_rank"))
    met = base.join(ranks, (F.col("_k") == F.col("_rk")) & (F.xxhash64("_t") == F.col("_rh")))
    return met.select(F.col("_rank").cast("long").alias("_k"), "_t", *(F.col(f"`{c}`") for c in docs.columns))
