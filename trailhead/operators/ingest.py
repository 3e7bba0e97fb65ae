"""From files to nodes, edges, aliases and vectors, a batch of changes at a time and set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema, session
from ..functions import text
from ..functions.hashing import fnv1a
from ..sources import parse
from . import alias as aliases
from . import layered, store

CALLS, IMPLEMENTS = "CALLS", "IMPLEMENTS"


def node_id(path: Column, simhash: Column) -> Column:
    """The same function shape in the same file has the same id, in every run and retry."""
    return F.substring(F.sha2(F.concat_ws("\x1f", path, simhash.cast("string")), 256), 1, 32)


def match(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """``spans`` (seq, file_path, pos, simhash, …) with id, is_new and renamed_from.

    A shape that is active in the same file keeps its node.  Else the node is new, and if the shape is active anywhere
    (in the store; else in an earlier file of the batch) the old id is renamed to it.
    """
    here = store.by_simhash(nodes, spans, True).withColumnRenamed("id", "_here")
    there = store.by_simhash(nodes, spans, False).withColumnRenamed("id", "_there")
    m = spans.join(here, ["simhash", "file_path"], "left").join(there, ["simhash"], "left")
    m = m.withColumn("id", F.coalesce("_here", node_id(F.col("file_path"), F.col("simhash"))))
    first = Window.partitionBy("file_path", "simhash").orderBy("seq", "pos")
    m = m.withColumn("_n", F.row_number().over(first))
    # a shape can be very common, so its first place comes from an aggregation, not from a window over all of it
    lead = m.groupBy("simhash").agg(F.min(F.struct("seq", "file_path", "pos", "id")).alias("m")).select("simhash", F.col("m.id").alias("_lead"))
    m = m.join(lead, "simhash")
    new = F.col("_here").isNull() & (F.col("_n") == 1)
    old = F.coalesce("_there", "_lead")
    return m.withColumns({"is_new": new, "renamed_from": F.when(new & (old != F.col("id")) & (F.col("parse_confidence") > 0), old)}).drop("_here", "_there", "_n", "_lead")


def symbols(matched: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, stubs, alias events) of matched spans.

    Callees become CALLS edges of new nodes, names IMPLEMENTS edges of all; a symbol's stub is inactive; the last definer
    wins the symbol.
    """
    real = matched.where("parse_confidence > 0")
    at = ["seq", "file_path", "pos"]
    calls = real.where("is_new").select(*at, "id", F.explode("calls").alias("sym")).where("length(sym) > 0").select(*at, F.col("id").alias("source_id"), F.concat(F.lit("sym:"), "sym").alias("target_id"), F.lit(CALLS).alias("type"))
    names = real.where("length(name) > 0").select(*at, F.col("id").alias("source_id"), F.concat(F.lit("sym:"), "name").alias("target_id"), F.lit(IMPLEMENTS).alias("type"))
    every = calls.unionByName(names)
    edges = every.select("source_id", "target_id", "type").distinct().withColumn("weight", F.lit(1.0))
    stubs = every.groupBy("target_id").agg(F.min(F.struct(*at)).alias("m")).select(
        F.col("target_id").alias("id"), F.col("m.file_path").alias("file_path"), F.lit(0).cast("long").alias("byte_start"), F.lit(1).cast("long").alias("byte_end"),
        F.lit(0).cast("long").alias("simhash"), F.lit(False).alias("is_active"), F.lit(0.0).cast("float").alias("parse_confidence"),
    )
    renames = real.where("renamed_from IS NOT NULL").select(*at, F.lit(0).alias("step"), F.col("renamed_from").alias("old_id"), F.col("id").alias("new_id"), "commit_hash")
    defined = names.join(real.select(*at, "commit_hash"), at).select(*at, F.lit(1).alias("step"), F.col("target_id").alias("old_id"), F.col("source_id").alias("new_id"), "commit_hash")
    return edges, stubs, renames.unionByName(defined)


def changed(tables: dict[str, DataFrame], changes: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The rows of each table that ``changes`` (seq, file_path, content, commit_hash, op) alter, and a row of counters.

    op D, or no content: the path's active nodes are tombstoned and lose their edges and vectors (rows with ``_gone``).
    Deletes come before upserts.  Of several changes to a path the last one counts.  Applying the same changes again changes
    nothing.  Tables are looked into, not written: what comes out is of the size of the change.
    """
    nodes, edges, alias, vectors = (tables[k] for k in ("nodes", "edges", "alias", "vectors"))
    last = store.latest(changes, ["file_path"], "seq").withColumn("_dead", F.expr("coalesce(op = 'D', false) OR content IS NULL OR length(content) = 0"))
    files = last.select("seq", "file_path", F.expr("CASE WHEN NOT _dead THEN content END").alias("content"), "commit_hash", "_dead")
    spans = parse.exploded(parse.parse(files), outer=True)
    cut = F.make_valid_utf8(F.substring(F.col("content"), (F.col("byte_start") + 1).cast("int"), (F.col("byte_end") - F.col("byte_start")).cast("int")).cast("string"))
    # files are read and parsed once; what follows reads the spans, each with its own text only, and that only for new nodes
    parsed = session.checkpointed(spans.withColumn("snippet", cut).drop("content"))
    listed = parsed.where("pos IS NULL OR pos = 0").select("file_path", "_dead")
    dead = session.checkpointed(nodes.where("is_active").join(listed.where("_dead"), "file_path", "left_semi"))
    alive = nodes.join(dead.select("id"), "id", "left_anti")
    m = session.checkpointed(match(parsed.where("pos IS NOT NULL").drop("_dead", "snippet"), alive))
    n = m.count()
    whole = F.col("parse_confidence") == 0
    kept = m.where(~whole | F.col("is_new"))  # a whole file that is known stays as it is
    new_nodes = store.latest(
        kept.select("id", "file_path", "byte_start", "byte_end", "simhash", F.lit(True).alias("is_active"), "parse_confidence", (F.col("seq") * 2**20 + F.col("pos")).alias("_order")), ["id"], "_order"
    ).drop("_order")
    new_edges, stubs, events = symbols(m)  # both ends of each edge are nodes of the batch or stubs
    have = nodes.join(stubs.select("id"), "id", "left_semi").select("id")
    new_stubs = stubs.join(have, "id", "left_anti")
    numbered = events.withColumn("seq", (F.col("seq") * 2**21 + F.col("pos") * 2 + F.col("step")).cast("long"))
    n_new = m.where("is_new").count()
    place = lambda df, *more: layered.dealt(df, n_new, "file_path", "pos").select("file_path", "pos", *more)
    fresh = place(m.where("is_new"), "id").join(place(parsed.where("pos IS NOT NULL"), "snippet"), ["file_path", "pos"]).select("id", "snippet")
    embedded = text.embed(layered.dealt(fresh, n, "id").dropDuplicates(["id"]), "snippet").select("id", "vector")
    lost = vectors.join(dead.select("id"), "id", "left_semi").withColumn("_gone", F.lit(True))
    errors = m.where("parse_error IS NOT NULL").select(F.col("file_path").alias("path"), F.col("parse_error").alias("message"))
    errors = errors.groupBy("path").agg(F.max("message").alias("message")).withColumn("kind", schema.error_kind(F.col("message")))

    def over(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
        """Deletes and, over them, upserts."""
        cols = [c for c in new.columns if c != "_gone"]
        rows = old.select(*cols, "_gone", F.lit(0).cast("long").alias("_v")).unionByName(new.select(*cols, F.lit(False).alias("_gone"), F.lit(1).cast("long").alias("_v")))
        return layered.newest(rows, keys, n).drop("_v")

    inactive = dead.withColumns({"is_active": F.lit(False), "_gone": F.lit(False)})
    out = {
        "nodes": over(inactive, store.check_nodes(new_nodes.unionByName(new_stubs)), schema.KEYS["nodes"]),
        "edges": over(store.gone_edges(edges, dead), new_edges, schema.KEYS["edges"]),
        "alias": aliases.increment(alias, numbered.select("seq", "old_id", "new_id", "commit_hash")).withColumn("_gone", F.lit(False)),
        "vectors": over(lost, embedded, schema.KEYS["vectors"]),
        "errors": errors.withColumn("_gone", F.lit(False)),
    }
    no = F.lit(0).cast("long")
    one = lambda **flags: [F.coalesce(flags[c].cast("long"), no).alias(c) if c in flags else no.alias(c) for c in COUNTERS]
    counted = (
        listed.select(*one(files_processed=F.lit(1), paths_tombstoned=F.col("_dead")))
        .unionByName(m.select(*one(nodes_upserted=F.col("is_new"), nodes_skipped=whole & ~F.col("is_new"), parse_failures=F.col("parse_error").isNotNull())))
        .unionByName(dead.select(*one(nodes_tombstoned=F.lit(1))))
    )
    return out, counted.agg(*(F.coalesce(F.sum(c), no).alias(c) for c in COUNTERS))


COUNTERS = ("files_processed", "paths_tombstoned", "nodes_upserted", "nodes_skipped", "parse_failures", "nodes_tombstoned")


def apply(tables: dict[str, DataFrame], changes: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The whole tables after ``changes`` (see ``changed``), and a row of counters."""
    moved, stats = changed(tables, changes)
    return tables | {t: layered.overlay(tables[t], rows, schema.KEYS[t]) for t, rows in moved.items()}, stats


def path_fingerprint(path: Column) -> Column:
    """The fingerprint of a file that no grammar takes: its path's hash."""
    return fnv1a(path)
