"""Incremental ingestion: a stream of change rows applied in micro-batches.

A change row is (seq, file_path, op, commit_hash, content); op U or D.  Each batch becomes one version of the store, whose
manifest remembers the batch, so a batch that is delivered again after a failure is skipped.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ingest
from ..operators.store import Store

CHANGE = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("file_path", T.StringType()), T.StructField("op", T.StringType()),
    T.StructField("commit_hash", T.StringType()), T.StructField("content", T.BinaryType()),
])
STATEFUL = ("nodes", "edges", "alias", "vectors", "errors")


def change_rows(spark: SparkSession, commit: str, upserts: list[str], deletes: list[str]) -> DataFrame:
    """Change rows of one commit: deletes first, then upserts (content is joined later)."""
    rows = [(i, p, op, commit) for i, (op, p) in enumerate([*(("D", p) for p in deletes), *(("U", p) for p in upserts)])]
    return spark.createDataFrame(rows, "seq long, file_path string, op string, commit_hash string")


def apply_batch(store: Store, batch: DataFrame, batch_id: int = -1) -> DataFrame | None:
    """Apply change rows and publish; returns the counters, or None for a batch that a version holds already."""
    if batch_id >= 0 and batch_id <= store.last_batch():
        return None
    version = store.version()
    moved, stats = ingest.changed({t: store.read(t, version) for t in STATEFUL}, batch)
    counted = stats.collect()  # one row
    store.upsert(moved, batch_id, version, sum(counted[0][c] for c in ("nodes_upserted", "nodes_skipped", "nodes_tombstoned")))
    return store.spark.createDataFrame(counted, stats.schema)


def run(spark: SparkSession, source: str, store: Store, checkpoint: str, files_per_batch: int = 100):
    """Take all change files (Parquet) that have arrived and stop; returns the finished query."""
    stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(lambda df, i: apply_batch(store, df, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


#: Batches whose rows lie beside the state before they are folded into it.
COMPACT = 8


def _versions(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Batches whose table of a kind was written to its end, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [n for n in names if re.fullmatch(rf"{kind}\d+", n) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n[len(kind) :]) for n in done)


def upsert_stream(spark: SparkSession, source: str, schema: T.StructType, keys: list[str], seq: list[str], out: str, checkpoint: str, files_per_batch: int = 1, compact: int = COMPACT) -> DataFrame:
    """Keyed last-write-wins state of a stream of Parquet rows, kept below ``out``; returns the state as it is now.

    A micro-batch writes only its own newest rows (``delta<batch>``); every ``compact`` batches the deltas are folded into
    a ``base<batch>``.  The state is the newest base and the deltas after it.  A row is compared by its own order
    (``seq``), so batches may come in any order and repeat: a batch that is delivered again overwrites its delta.  A
    second call takes what has arrived since; if nothing has, the state is what it was, and empty before any row.
    """
    order = F.struct(*seq)
    empty = spark.createDataFrame([], schema).withColumn("_o", order)
    rest = [c for c in empty.columns if c not in keys and c != "_o"]

    def newest(rows: DataFrame) -> DataFrame:
        best = rows.groupBy(*keys).agg(F.max(F.struct("_o", *rest)).alias("_m"))
        return best.select(*keys, "_m.*").select(*empty.columns)

    def state() -> DataFrame:
        bases = _versions(spark, out, "base")
        top = bases[-1] if bases else -1
        paths = [f"{out}/delta{v}" for v in _versions(spark, out, "delta") if v > top] + ([f"{out}/base{top}"] if bases else [])
        return newest(spark.read.schema(empty.schema).parquet(*paths)) if paths else empty

    def step(df: DataFrame, batch_id: int) -> None:
        new = df.select(*schema.fieldNames()).withColumn("_o", order)
        newest(new).write.mode("overwrite").parquet(f"{out}/delta{batch_id}")
        if batch_id % compact == compact - 1:
            state().write.mode("overwrite").parquet(f"{out}/base{batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return state().drop("_o")


def ndjson(rows: DataFrame) -> DataFrame:
    """Rows as JSON lines, for ``write.text``."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
