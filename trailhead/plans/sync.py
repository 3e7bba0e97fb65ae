"""Bulk and incremental updates of a store from a repository."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, order, store
from ..sources import files, git, parse, queue
from ..streaming import changes


def full(spark: SparkSession, repo: str, st: store.Store, commit: str = "sync") -> DataFrame:
    """Take all source files as they are; paths that are gone are tombstoned.  Returns the counters."""
    now = files.scan(spark, repo)
    known = st.read("nodes").where("is_active").select("file_path").distinct()
    gone = known.join(now.select("file_path"), "file_path", "left_anti").select("file_path", F.lit(None).cast("binary").alias("content"), F.lit("D").alias("op"))
    # files in the order of their paths, so the last definer of a name is the last by path
    place = order.numbered(now.select("file_path").unionByName(gone.select("file_path")), F.col("file_path"))
    rows = now.withColumn("op", F.lit("U")).unionByName(gone).join(place, "file_path")
    return changes.apply_batch(st, rows.select(F.col("_rank").alias("seq"), "file_path", "op", F.lit(commit).alias("commit_hash"), "content"))


def increment(spark: SparkSession, repo: str, st: store.Store, commit: str, upserts: list[str], deletes: list[str]) -> DataFrame:
    """Take the named paths of one commit, deletes first."""
    return take(spark, repo, st, changes.change_rows(spark, commit, upserts, deletes))


def take(spark: SparkSession, repo: str, st: store.Store, listed: DataFrame, batch_id: int = -1) -> DataFrame | None:
    """Take listed paths (seq, file_path, op, commit_hash) as the files are now; None for a batch that the store holds."""
    batch = files.load(files.scan(spark, repo), listed)
    content = F.when(F.col("op") == "U", F.col("content"))
    return changes.apply_batch(st, batch.select("seq", "file_path", "op", "commit_hash", content.alias("content")), batch_id)


#: Entries of one micro-batch, at most, and batches of other streams before a queue's first.
ENTRIES = 1 << 20


def drain(spark: SparkSession, repo: str, st: store.Store, folder: str, checkpoint: str, after=lambda entry: None) -> int:
    """Take all that the hook has queued, an entry a version, and stop; returns how many entries.

    Exactly once: a version remembers its batch and entry, and the queue's files go after the checkpoint has them.  ``after`` is
    called when an entry's version is written.
    """
    spark.dataSource.register(queue.HookQueue)
    done = []

    def step(df: DataFrame, batch_id: int) -> None:
        rows = df.collect()  # paths of a few commits
        for n, name in enumerate(sorted({r["entry"] for r in rows})):
            mine = [(r["seq"], r["file_path"], r["op"], r["commit_hash"]) for r in rows if r["entry"] == name]
            take(spark, repo, st, spark.createDataFrame(mine, "seq long, file_path string, op string, commit_hash string"), batch_id * ENTRIES + n)
            after(name)
            done.append(name)

    stream = spark.readStream.format("hook_queue").option("folder", folder).load()
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    ends = [re.findall(r"entry\W+([\w-]+)", str(x["sources"][0]["endOffset"])) for x in query.recentProgress]  # {"entry": name}
    if any(ends):
        queue.drop(folder, max(e[0] for e in ends if e))
    return len(done)


def history(spark: SparkSession, repo: str, st: store.Store) -> int:
    """Record which nodes each commit added or changed, and a note for each commit.  Live nodes are not touched."""
    rows = git.changes(spark, repo).where(files.is_source(F.col("file_path")) & (F.length("content") > 0))
    spans = parse.exploded(parse.parse(rows.select("commit_hash", "timestamp", "message", "file_path", "content")))
    named = spans.withColumn("node_id", ingest.node_id(F.col("file_path"), F.col("simhash")))
    new = git.history_rows(named).select("node_id", "commit_hash", "timestamp", "synthetic_msg").distinct()
    noted = new.withColumn("synthetic_msg", F.nullif("synthetic_msg", F.lit("")))
    return st.upsert({"history": noted, "annotations": git.annotations(named).select("commit_hash", "path", "text")})


def as_of(rows: DataFrame, at: int) -> DataFrame:
    """The newest history row of each node at a time (an extension)."""
    return store.latest(rows.where(F.col("timestamp") <= at), ["node_id"], "timestamp")
