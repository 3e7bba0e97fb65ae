"""Registered queries of the layered store, incremental aliases, parsed sources and batches of questions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema, session
from ..functions import text, wire
from ..operators import alias, graph, ingest, postings, store
from ..sources import parse
from ..streaming import changes, chunks, matching
from . import retrieve
from .path_queries import _corpus
from .projections import buys, prints, read, seeds
from .registry import query


def _store(spark: SparkSession, **options) -> store.Store:
    return store.Store(spark, f"{session.work_folder(spark)}/store-{uuid.uuid4().hex}", **options)


def _part(c: str = "target_id") -> Column:
    return F.substring(c, 3, 20).cast("long")


# --- the layered store


@query
def q_upsert_delta(spark: SparkSession, d: str) -> DataFrame:
    """Purchases as a stored table, then three batches over it: heavier, gone, and back again."""
    st, base = _store(spark, bucket_rows=1 << 14), session.checkpointed(buys(spark, d))
    st.upsert({"edges": base})
    st.upsert({"edges": base.where(_part() % 100 == 7).withColumn("weight", F.col("weight") + 10)})
    st.upsert({"edges": base.where(_part() % 50 == 7).withColumn("_gone", F.lit(True))})
    st.upsert({"edges": base.where(_part() % 200 == 7).withColumn("weight", F.lit(0.5))})
    return st.read("edges").select("source_id", "target_id", "weight")


@query
def q_tombstone_layers(spark: SparkSession, d: str) -> DataFrame:
    """Some parts go: their purchases are marked in a delta, found by either end; no base file is written anew."""
    st = _store(spark, bucket_rows=1 << 14)
    st.upsert({"edges": buys(spark, d)})
    files = st.layers("edges")["base"]
    dead = read(spark, d, "part").where("p_partkey % 1000 < 2").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"))
    dead = dead.union(read(spark, d, "customer").where("c_custkey % 1000 = 1").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string"))))
    st.upsert({"edges": store.gone_edges(st.read("edges"), dead)})
    same = st.layers("edges")["base"] == files
    return st.read("edges").select("source_id", "target_id", "weight", F.lit(same).alias("base_kept"))


@query
def q_migration(spark: SparkSession, d: str) -> DataFrame:
    """Errors stored under the first schema, read under the present one before and after a batch upgrades the table."""
    docs = read(spark, d, "documents")
    name = F.when(F.col("doc_id") % 3 == 0, "SyntaxError").when(F.col("doc_id") % 3 == 1, "ValueError")
    rows = docs.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.concat_ws(": ", name, F.coalesce("lang", F.lit(""))).alias("message"))
    old = _store(spark, at=1)
    new = store.Store(spark, old.folder)
    old.upsert({"errors": rows.where("doc_id % 2 = 0").select("path", "message")})
    before = session.checkpointed(new.read("errors").withColumn("step", F.lit(1)))
    new.upsert({"errors": rows.where("doc_id % 5 = 0").select("path", F.lit("again").alias("message"), F.lit("Given").alias("kind"))})
    return before.unionByName(new.read("errors").withColumn("step", F.lit(2))).select("step", "path", "message", "kind")


@query
def q_alias_increment(spark: SparkSession, d: str) -> DataFrame:
    """Users' renames recorded in three batches, each an increment on a stored table."""
    e = read(spark, d, "events").select("user_id", "event_id", "event_type")
    key = lambda t: F.concat_ws("/", F.col("user_id").cast("string"), t)
    w = Window.partitionBy("user_id").orderBy("event_id")
    ev = e.select(F.col("event_id").alias("seq"), key(F.col("event_type")).alias("old_id"), key(F.lead("event_type").over(w)).alias("new_id"), F.col("event_id").cast("string").alias("commit_hash"))
    ev = session.checkpointed(ev.where("new_id IS NOT NULL AND old_id <> new_id AND instr(new_id, '/') > 0 AND right(new_id, 1) <> '/'"))
    top = ev.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    st = _store(spark, bucket_rows=1 << 14)
    for lo, hi in ((-1, top // 2), (top // 2, top - top // 50), (top - top // 50, top)):
        st.upsert({"alias": alias.increment(st.read("alias"), ev.where((F.col("seq") > lo) & (F.col("seq") <= hi)))})
    return st.read("alias")


# --- parsed sources


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents as source files (two of three Python, the others C++); every seventh has a broken function in its middle.

    A method's docstring or a comment holds the document's whole text, so places are counted in its bytes.
    """
    docs = read(spark, d, "documents")
    i = F.col("doc_id").cast("string")
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r'[\x00-\x1F"\\*]', " ")
    broken = F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("def broken_"), i, F.lit("(x:\n    return lost(x, (\n\n"))).otherwise("")
    python = F.concat(
        F.lit("import os\n\n\ndef a_"), i, F.lit("(x):\n    for i in x:\n        g_"), (F.col("doc_id") % 7).cast("string"), F.lit("(i)\n    return h_"), (F.col("doc_id") % 5).cast("string"), F.lit("(x)\n\n"), broken,
        F.lit("class C:\n    def m_"), i, F.lit('(self):\n        """'), said, F.lit('"""\n        return self.p(a_'), i, F.lit("(1))\n"),
    )
    c = F.concat(
        F.lit("#include <x>\nint a_"), i, F.lit("(int x) { if (x) { return g_"), (F.col("doc_id") % 7).cast("string"), F.lit("(x); } return h_"), (F.col("doc_id") % 5).cast("string"), F.lit("(x); }\nvoid K::m_"), i,
        F.lit("() { /* "), said, F.lit(" */ a_"), i, F.lit("(1); }\n"),
    )
    kind = F.col("doc_id") % 3 == 2
    return docs.select(F.col("doc_id").alias("seq"), F.concat(F.lit("d"), i, F.when(kind, ".cpp").otherwise(".py")).alias("file_path"), F.lit("U").alias("op"), F.lit("c").alias("commit_hash"), F.encode(F.when(kind, c).otherwise(python), "UTF-8").alias("content"))


@query
def q_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where each function of the sources begins and ends; a broken one costs only itself."""
    spans = parse.exploded(parse.parse(_sources(spark, d).select("file_path", "content")))
    return spans.select("file_path", "pos", "byte_start", "byte_end", "name", F.col("parse_confidence").cast("double").alias("confidence"), F.col("parse_error").isNotNull().alias("broken"))


@query
def q_calls(spark: SparkSession, d: str) -> DataFrame:
    spans = parse.exploded(parse.parse(_sources(spark, d).select("file_path", "content")))
    return spans.select("file_path", "name", F.posexplode("calls").alias("n", "callee"))


@query
def q_code_edges(spark: SparkSession, d: str) -> DataFrame:
    """The sources taken in by two batches into a stored code base, the second over half of the first and with deletes: the
    edges of the functions, by file."""
    rows = _sources(spark, d)
    st = _store(spark)
    changes.apply_batch(st, rows.where("seq % 2 = 0"), 0)
    changes.apply_batch(st, rows.withColumn("op", F.when(F.col("seq") % 10 == 1, "D").otherwise("U")).where("seq % 4 <> 2"), 1)
    n = st.read("nodes").select(F.col("id").alias("source_id"), "file_path")
    return st.read("edges").join(n, "source_id").select("file_path", "type", "target_id")


@query
def q_code_counters(spark: SparkSession, d: str) -> DataFrame:
    """The counters of a batch of sources, broken functions among them."""
    empty = {t: spark.createDataFrame([], schema.TABLES[t]) for t in changes.STATEFUL}
    return ingest.changed(empty, _sources(spark, d))[1]


# --- batches of questions


def _asked(spark: SparkSession, d: str) -> retrieve.Batch:
    """Every fiftieth document as a question; every ninth document is no node, and its links are unknown."""
    tables, now = _corpus(spark, d)
    lost = lambda c: F.pmod(F.col(c).cast("long"), F.lit(9)) == 4
    tables |= {"nodes": tables["nodes"].where(~lost("id")), "edges": tables["edges"].where(~lost("source_id")), "vectors": session.checkpointed(tables["vectors"])}
    asked = read(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    return retrieve.build_batch(tables, now, asked, created_at=1)


@query
def q_questions(spark: SparkSession, d: str) -> DataFrame:
    """The context of every question, in one plan."""
    got = _asked(spark, d).requests.select("query_id", F.posexplode("context").alias("pos", "c"))
    return got.select("query_id", "pos", F.col("c.nodeId").alias("node_id"), F.sha2("c.codeSnippet", 256).alias("snippet_sha256"), F.col("c.uncertain").alias("uncertain"))


@query
def q_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Questions that match nothing, and such whose seed has no node and leads to none."""
    return _asked(spark, d).refused


# --- matching over a stream


@query
def q_stream_match(spark: SparkSession, d: str) -> DataFrame:
    """Documents as shapes that appear in order, some of which go again, in three files and two runs of the stream."""
    p = prints(spark, d).where("doc_id IS NOT NULL").select("doc_id", "source", "simhash")
    here = p.select((F.col("doc_id") * 2).alias("seq"), F.col("source").alias("file_path"), F.lit("U").alias("op"), "simhash")
    gone = p.where("doc_id % 5 = 0").select((F.col("doc_id") * 2 + 41).alias("seq"), F.col("source").alias("file_path"), F.lit("D").alias("op"), "simhash")
    rows = session.checkpointed(matching.spans(here.unionByName(gone)))
    top = rows.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    base = f"{session.work_folder(spark)}/match-{uuid.uuid4().hex}"
    cuts = [-1, top // 3, top // 2, top]
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        rows.where((F.col("seq") > lo) & (F.col("seq") <= hi)).coalesce(1).write.mode("append").parquet(f"{base}/in")
        if i:
            matching.run(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(matching.MATCHED).parquet(f"{base}/out").select("seq", "id", "is_new", "renamed_from")


# --- pruned search


@query
def q_topk_pruned(spark: SparkSession, d: str) -> DataFrame:
    """The five documents nearest to every fiftieth one, from inverted buckets."""
    v = session.checkpointed(text.embed_sparse(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "text").select("id", "embedding"))
    asked = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    best, _ = postings.search(session.checkpointed(postings.index(v)), asked, 5)
    return best.select("query_id", "id", F.round("score", 9).alias("score"), "rank")


# --- walks past hubs


@query
def q_hub_walks(spark: SparkSession, d: str) -> DataFrame:
    """Walks over customers and their nations, whose edges stay in the table: the rounds, however few the edges are."""
    c = read(spark, d, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("c"), F.concat(F.lit("n:"), F.col("c_nationkey").cast("string")).alias("n"), (F.col("c_custkey") % 97 + 1).cast("double").alias("w"))
    kind = F.lit("IN").alias("type")
    e = c.select(F.col("c").alias("source_id"), F.col("n").alias("target_id"), kind, F.lit(1.0).alias("weight")).unionByName(c.select(F.col("n").alias("source_id"), F.col("c").alias("target_id"), kind, F.col("w").alias("weight")))
    return graph.local_push(e, seeds(spark, d), 0.3, 1e-5, 4, small=0, hub=2).select("seed", "id", F.round("score", 9).alias("score"))


# --- dense vectors, and times that nobody passes


@query
def q_embed_dense(spark: SparkSession, d: str) -> DataFrame:
    """The components of each text's unit vector that are not zero."""
    v = text.embed(read(spark, d, "documents").select("doc_id", "text"), "text")
    each = v.select("doc_id", F.size("vector").cast("long").alias("dim"), F.posexplode("vector").alias("bucket", "x"))
    return each.where("x <> 0").select("doc_id", "dim", "bucket", F.round(F.col("x").cast("double"), 5).alias("x"))


@query
def q_trace_times(spark: SparkSession, d: str) -> DataFrame:
    """Traces of every fiftieth document as a question, stamped when they are made."""
    docs = read(spark, d, "documents")
    at = F.unix_timestamp()
    traces = spark.createDataFrame([], schema.TRACES)
    for part in (0, 1):
        ids = docs.where((F.col("doc_id") % 50 == 0) & (F.col("doc_id") % 2 == part)).select(F.col("doc_id").cast("string").alias("id"), F.row_number().over(Window.orderBy("doc_id")).alias("rank"))
        traces = store.record_trace(traces, f"t{part}", ids)
    return traces.select("trace_id", F.array_join("node_ids", ",").alias("node_ids"), (F.abs(at - F.col("created_at")) < 3600).alias("now"))


# --- answers as a stream of lines


#: Lines of a file of answers, which is read whole.
CHUNK_LINES = 1 << 17


@query
def q_chunk_stream(spark: SparkSession, d: str) -> DataFrame:
    """Users' events as chunks of answers, the last event ends one; in three parts of JSON lines and two runs.

    A part's files each hold some users' lines, in order, and about ``CHUNK_LINES`` of them.
    """
    e = read(spark, d, "events").select("user_id", "event_id", "event_type").where("event_id IS NOT NULL")
    ends = e.groupBy("user_id").agg(F.max("event_id").alias("last"))
    chunk = F.struct(F.col("user_id").cast("string").alias("traceId"), F.concat("event_type", F.lit('"\\\n')).alias("textDelta"), (F.col("event_id") == F.col("last")).alias("done"), (F.col("event_id") % 50 == 0).alias("unverifiedCitation"))
    lines = session.checkpointed(e.join(ends, "user_id").select("event_id", "user_id", wire.encode_chunk(chunk).alias("value")))
    top, n = lines.agg(F.coalesce(F.max("event_id"), F.lit(0)), F.count("*")).first()
    n = max(1, -(-n // (3 * CHUNK_LINES)))
    base = f"{session.work_folder(spark)}/chunks-{uuid.uuid4().hex}"
    cuts = [-1, top // 3, top // 2, top]
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        part = lines.where((F.col("event_id") > lo) & (F.col("event_id") <= hi)).repartition(n, "user_id").sortWithinPartitions("event_id")
        part.select("value").write.mode("append").text(f"{base}/in")
        if i:
            chunks.run(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", n)
    return spark.read.schema(chunks.ANSWER).parquet(f"{base}/out").select("trace_id", F.sha2("text", 256).alias("text_sha256"), "pieces", "unverified")
