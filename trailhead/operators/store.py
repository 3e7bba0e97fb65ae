"""The stored tables as DataFrames: last-write-wins merges, tombstones, look-ups.

A change is a DataFrame; a merge is a union and one aggregation by key (no index, no lookup a row).  ``layered.Store`` keeps
tables in a folder; ``gone_nodes`` and ``gone_edges`` are a tombstone's rows for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from .layered import Conflict, Store  # noqa: F401  the stored form of these tables


def latest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the largest ``seq`` for each key; combined before the shuffle.  Equal seqs: the largest row."""
    rest = [c for c in rows.columns if c not in keys and c != seq]
    best = rows.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("_m"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_m.{c}").alias(c) for c in rows.columns))


def merge(base: DataFrame, changes: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """``base`` with ``changes`` written over it by key; ``seq`` orders changes among themselves."""
    cols = base.columns
    old = base.withColumns({"_gen": F.lit(0), "_seq": F.lit(None).cast("long")})
    new = changes.withColumns({"_gen": F.lit(1), "_seq": F.col(seq).cast("long") if seq else F.lit(0).cast("long")}).select(*cols, "_gen", "_seq")
    order = F.struct("_gen", "_seq", *(c for c in cols if c not in keys))
    best = old.unionByName(new).groupBy(*keys).agg(F.max(order).alias("_m"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_m.{c}").alias(c) for c in cols))


def check_nodes(nodes: DataFrame) -> DataFrame:
    """Raises, when it runs, on a byte range that does not end after its start."""
    bad = F.raise_error(F.concat(F.lit("byte range of node "), F.col("id"), F.lit(" does not end after its start")))
    return nodes.withColumn("byte_end", F.when(F.col("byte_end") > F.col("byte_start"), F.col("byte_end")).otherwise(bad))


def upsert_nodes(nodes: DataFrame, changes: DataFrame, seq: str | None = None) -> DataFrame:
    return merge(nodes, check_nodes(changes), schema.KEYS["nodes"], seq)


def tombstone(nodes: DataFrame, edges: DataFrame, dead: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deactivate the nodes in ``dead`` (id) and drop the edges that touch them."""
    ids = dead.select(F.col("id").alias("_dead")).distinct()
    marked = nodes.join(ids, nodes.id == ids._dead, "left").withColumn("is_active", F.col("is_active") & F.col("_dead").isNull()).drop("_dead")
    left = edges.join(ids, edges.source_id == ids._dead, "left_anti")
    return marked, left.join(ids, left.target_id == ids._dead, "left_anti")


def gone_nodes(nodes: DataFrame, dead: DataFrame) -> DataFrame:
    """The changed rows of a tombstone: the nodes of ``dead`` (id), inactive."""
    return nodes.join(dead.select("id").distinct(), "id", "left_semi").withColumn("is_active", F.lit(False))


def gone_edges(edges: DataFrame, dead: DataFrame) -> DataFrame:
    """The edges that touch ``dead`` (id), as deletes (``_gone``).  One walk over the edges; no edge row moves but these."""
    ids = dead.select(F.col("id").alias("_dead")).distinct()
    out = edges.join(ids, edges.source_id == ids._dead, "left_semi").unionByName(edges.join(ids, edges.target_id == ids._dead, "left_semi"))
    return out.withColumn("_gone", F.lit(True))


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes; others are dropped silently."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    left = edges.join(ids, edges.source_id == ids._id, "left_semi")
    return left.join(ids, left.target_id == ids._id, "left_semi")


def upsert_edges(edges: DataFrame, changes: DataFrame, nodes: DataFrame, seq: str | None = None) -> DataFrame:
    return merge(edges, with_ends(changes, nodes), schema.KEYS["edges"], seq)


def record_history(history: DataFrame, changes: DataFrame, seq: str | None = None) -> DataFrame:
    """One row for each (node, commit); an empty message is null."""
    return merge(history, changes.withColumn("synthetic_msg", F.nullif("synthetic_msg", F.lit(""))), schema.KEYS["history"], seq)


def trace_rows(ranked: DataFrame, created_at: int | None = None) -> DataFrame:
    """Trace rows from ``ranked`` (trace_id, id, rank): the ids of each trace, in order."""
    at = F.lit(created_at).cast("long") if created_at is not None else F.unix_timestamp()
    ids = ranked.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("node_ids"))
    return ids.select("trace_id", "node_ids", at.alias("created_at"))


def record_trace(traces: DataFrame, trace_id: str, ranked: DataFrame, created_at: int | None = None) -> DataFrame:
    """Append a trace: the ids of ``ranked`` (id, rank), in order; one without nodes is empty."""
    at = F.lit(created_at).cast("long") if created_at is not None else F.unix_timestamp()
    row = ranked.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("node_ids")).select(
        F.lit(trace_id).alias("trace_id"), "node_ids", at.alias("created_at")
    )
    return merge(traces, row, schema.KEYS["traces"])


def record_traces(traces: DataFrame, ranked: DataFrame, created_at: int | None = None) -> DataFrame:
    """Append many traces at once: ``ranked`` (trace_id, id, rank)."""
    return merge(traces, trace_rows(ranked, created_at), schema.KEYS["traces"])


def upsert_vectors(vectors: DataFrame, changes: DataFrame, seq: str | None = None) -> DataFrame:
    return merge(vectors, changes, schema.KEYS["vectors"], seq)


def remove_vectors(vectors: DataFrame, dead: DataFrame) -> DataFrame:
    return vectors.join(dead.select("id").distinct(), "id", "left_anti")


def get_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of ``ids`` (id), inactive ones and stubs too; unknown ids have no row."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def active_ids(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where((F.col("file_path") == path) & F.col("is_active")).select("id")


def by_simhash(nodes: DataFrame, wanted: DataFrame, same_file: bool) -> DataFrame:
    """(simhash[, file_path], id): an active node for each wanted fingerprint (of the same file); the smallest id."""
    keys = ["simhash", "file_path"] if same_file else ["simhash"]
    return nodes.where("is_active").join(wanted.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.min("id").alias("id"))
