"""Registered queries of walks, stored tables, ingestion and the whole question path.

Each calls the operator itself on projections of the driver's tables; its SQL is in ``oracle_paths``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema, session
from ..functions import text, wire
from ..operators import alias, graph, ingest, order, store
from ..sources import files, git
from ..streaming import changes
from . import retrieve
from .projections import buys, following, nodes, read, seeds, supplied, tagged, trade, trade_nodes
from .registry import query
from .retrieve_text import CITED, QUESTION, UNCITED

# --- walks and choice


@query
def q_push_rounds(spark: SparkSession, d: str) -> DataFrame:
    out = graph.push_rounds(session.checkpointed(trade(spark, d)), seeds(spark, d), 0.1, 3)
    return out.select("seed", "id", F.round("score", 9).alias("score"))


@query
def q_local_push(spark: SparkSession, d: str) -> DataFrame:
    return graph.local_push(trade(spark, d), seeds(spark, d), *graph.WIDE).select("seed", "id", F.round("score", 9).alias("score"))


@query
def q_dual_horizon(spark: SparkSession, d: str) -> DataFrame:
    return graph.dual_horizon(trade(spark, d), seeds(spark, d)).select("seed", "id", F.round("score", 9).alias("score"), "rank")


def _balances(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's suppliers by balance, in lists of a budget's length: a query of its own for each list."""
    s = read(spark, d, "supplier")
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    every = s.withColumn("_n", F.row_number().over(w) - 1).withColumn("rank", F.col("_n") % 40 + 1)
    return every.select((F.col("s_nationkey") * 1_000_000 + F.floor(F.col("_n") / 40)).cast("long").alias("query_id"), tagged("s", F.col("s_suppkey")).alias("id"), (F.col("s_acctbal") / 10000).alias("relevance"), "rank")


@query
def q_pair_redundancy(spark: SparkSession, d: str) -> DataFrame:
    got = graph.pair_redundancy(_balances(spark, d).select("query_id", "id"), session.checkpointed(supplied(spark, d)))
    return got.select("query_id", "a", "b", F.round("redundancy", 9).alias("redundancy"))


@query
def q_mmr(spark: SparkSession, d: str) -> DataFrame:
    return graph.mmr(_balances(spark, d), session.checkpointed(supplied(spark, d)), 10).select("query_id", "id", F.round("score", 9).alias("score"), "pick")


@query
def q_hydrate(spark: SparkSession, d: str) -> DataFrame:
    """The walks' ranked lists with their nodes and the number of their out-edges."""
    e = session.checkpointed(trade(spark, d))
    kept, out = retrieve.hydrate(graph.dual_horizon(e, seeds(spark, d)).select("seed", "id", "rank"), trade_nodes(spark, d), e)
    n = out.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n_edges"))
    return kept.join(n, "id", "left").select("seed", "id", "rank", "file_path", "byte_end", "uncertain", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


# --- aliases


def _renames(spark: SparkSession, d: str) -> DataFrame:
    """Users' event types as renames in time order (an id may be renamed again and in circles)."""
    e = read(spark, d, "events").select("user_id", "event_id", "event_type")
    key = lambda t: F.concat_ws("/", F.col("user_id").cast("string"), t)
    w = Window.partitionBy("user_id").orderBy("event_id")
    ev = e.select("user_id", F.col("event_id").alias("seq"), key(F.col("event_type")).alias("old_id"), key(F.lead("event_type").over(w)).alias("new_id"), F.lead("event_type").over(w).alias("n"), F.col("event_id").cast("string").alias("commit_hash"))
    return ev.where("n IS NOT NULL AND old_id <> new_id").drop("n")


@query
def q_alias_fold(spark: SparkSession, d: str) -> DataFrame:
    return alias.fold(_renames(spark, d).withColumnRenamed("user_id", "component"))


@query
def q_alias_record(spark: SparkSession, d: str) -> DataFrame:
    """The older half is in the table when the newer half is recorded."""
    ev = session.checkpointed(_renames(spark, d).drop("user_id"))
    half = ev.agg(F.max("seq")).first()[0] // 2
    table = session.checkpointed(alias.record(spark.createDataFrame([], schema.ALIAS), ev.where(F.col("seq") <= half)))
    return alias.record(table, ev.where(F.col("seq") > half))


@query
def q_alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of a conversation leads to the last one."""
    c = read(spark, d, "conversations").select("conv_id", "turn").distinct()
    w = Window.partitionBy("conv_id").orderBy("turn")
    key = lambda t: F.concat_ws("/", F.col("conv_id").cast("string"), t.cast("string"))
    pairs = c.select(key(F.col("turn")).alias("old_id"), key(F.lead("turn").over(w)).alias("new_id"), F.lead("turn").over(w).alias("n")).where("n IS NOT NULL").drop("n")
    return alias.resolve(c.select(key(F.col("turn")).alias("id")), alias.closure(pairs)).select("id", "root")


# --- stored tables


@query
def q_upsert_edges(spark: SparkSession, d: str) -> DataFrame:
    """Purchases, some of them changed and supplies added; ends that are no nodes drop out of what is added."""
    base = session.checkpointed(buys(spark, d))
    more = base.where(F.substring("target_id", 3, 20).cast("long") % 7 == 0).withColumn("weight", F.col("weight") + 1).unionByName(supplied(spark, d))
    p, s = read(spark, d, "part"), read(spark, d, "supplier")
    known = read(spark, d, "customer").select(tagged("c", F.col("c_custkey")).alias("id")).union(p.where("p_size < 40").select(tagged("p", F.col("p_partkey")))).union(s.where("s_acctbal > 0").select(tagged("s", F.col("s_suppkey"))))
    return store.upsert_edges(base, more, known).select("source_id", "target_id", "weight")


@query
def q_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of which a third are replaced and a fifth removed."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "vec_id")
    new = e.where("vec_id % 3 = 0").withColumn("vector", F.reverse("vector"))
    now = store.remove_vectors(store.upsert_vectors(e.drop("vec_id"), new.drop("vec_id")), e.where("vec_id % 5 = 0").select("id"))
    return now.select("id", F.round(F.element_at("vector", 1).cast("double"), 6).alias("head"), F.size("vector").cast("long").alias("n"))


@query
def q_get_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Point look-ups: of documents and of ids that are none."""
    asked = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id")).union(read(spark, d, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string"))))
    return store.get_nodes(nodes(spark, d), asked).select("id", "file_path", "byte_end")


@query
def q_active_ids(spark: SparkSession, d: str) -> DataFrame:
    """The active nodes of the first path by name, after a tombstone of every third."""
    n = nodes(spark, d)
    path = n.agg(F.min("file_path")).first()[0]
    marked, _ = store.tombstone(n, spark.createDataFrame([], schema.EDGES), n.where("cast(id AS long) % 3 = 0").select("id"))
    return store.active_ids(marked, path)


@query
def q_history_of_commits(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as spans of commits: their history rows."""
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    spans = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("l_partkey").cast("string").alias("node_id"), F.col("o_orderkey").cast("string").alias("commit_hash"), F.lit(7).cast("long").alias("timestamp"), F.col("o_orderpriority").alias("message"))
    return git.history_rows(spans).select("node_id", "commit_hash", "timestamp", "synthetic_msg", "message")


@query
def q_annotations(spark: SparkSession, d: str) -> DataFrame:
    """A note for each order, at the first of its parts."""
    li = read(spark, d, "lineitem")
    spans = li.select(F.col("l_orderkey").cast("string").alias("commit_hash"), tagged("part", F.col("l_partkey")).alias("file_path"))
    return git.annotations(spans).select("commit_hash", "path", "text")


@query
def q_trace(spark: SparkSession, d: str) -> DataFrame:
    """All documents by length, a budget of them a trace: recorded beside others, replayed and rendered."""
    docs = read(spark, d, "documents")
    top = order.numbered(docs.select("doc_id", "n_chars"), F.desc("n_chars"), F.asc("doc_id"))
    top = top.select(F.concat(F.lit("t"), F.floor(F.col("_rank") / 40).cast("string")).alias("trace_id"), F.col("doc_id").cast("string").alias("id"), (F.col("_rank") % 40 + 1).alias("rank"))
    traces = session.checkpointed(store.record_traces(spark.createDataFrame([("other", ["1", "2"], 5), ("t0", ["3"], 6)], schema.TRACES), top, 7))
    kept, out = retrieve.replay_all(traces.where("trace_id <> 'other'"), nodes(spark, d), session.checkpointed(following(spark, d)))
    now = docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    shown = retrieve.render(retrieve.snippets(kept.withColumn("file_path", F.concat(F.lit("doc/"), "id")), now), out, ["trace_id"])
    return shown.join(traces, "trace_id").select("trace_id", F.sha2("text", 256).alias("text_sha256"), F.array_join("node_ids", ",").alias("node_ids"), "created_at")


# --- files and ingestion


@query
def q_is_source(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").select("page_id", F.concat(F.col("url"), F.element_at(F.array(*(F.lit(x) for x in (".py", ".txt", ".hpp", ".cppx"))), (F.col("page_id") % 4 + 1).cast("int"))).alias("path"))
    return p.select("page_id", F.coalesce(files.is_source(F.col("path")), F.lit(False)).alias("is_source"))


@query
def q_live_snippet(spark: SparkSession, d: str) -> DataFrame:
    """Characters 8 to 31 of each document, by byte range, from its file."""
    docs = read(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.select("doc_id", "file_path", F.octet_length(F.left("text", F.lit(7))).cast("long").alias("byte_start"), F.octet_length(F.left("text", F.lit(31))).cast("long").alias("byte_end"))
    cut = retrieve.snippets(n, docs.where("doc_id % 7 <> 0").select("file_path", F.encode("text", "UTF-8").alias("content")))
    return cut.select("doc_id", "snippet")


def _matched(spark: SparkSession, d: str) -> DataFrame:
    """Pages as functions that call what they link to; every fourth is known already, and every fifth has a name."""
    p = read(spark, d, "pages")
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))
    return p.select(
        F.col("page_id").alias("seq"), F.col("url").alias("file_path"), F.lit(0).alias("pos"), F.concat(F.lit("n"), F.col("page_id").cast("string")).alias("id"), (F.col("page_id") % 4 != 0).alias("is_new"),
        links.alias("calls"), F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("f"), (F.col("page_id") % 3).cast("string"))).otherwise("").alias("name"),
        F.lit(1.0).cast("float").alias("parse_confidence"), F.when(F.col("page_id") % 6 == 1, F.concat(F.lit("n"), (F.col("page_id") - 1).cast("string"))).alias("renamed_from"), F.lit("c").alias("commit_hash"),
    )


@query
def q_symbol_link(spark: SparkSession, d: str) -> DataFrame:
    return ingest.symbols(_matched(spark, d))[0]


@query
def q_symbol_stubs(spark: SparkSession, d: str) -> DataFrame:
    """Each symbol's stub: made once, at the first page that mentions it."""
    return ingest.symbols(_matched(spark, d))[1].select("id", "file_path", "byte_start", "byte_end", "is_active")


@query
def q_symbol_renames(spark: SparkSession, d: str) -> DataFrame:
    return ingest.symbols(_matched(spark, d))[2].select("seq", "step", "old_id", "new_id", "commit_hash")


def _files(spark: SparkSession, d: str) -> list[DataFrame]:
    """Pages as files, in two batches: those with even ids, then all, of which every eleventh is deleted.

    No grammar takes them, so each is one node, named and fingerprinted by its path.
    """
    rows = read(spark, d, "pages").where("url IS NOT NULL").select(F.col("page_id").alias("seq"), F.col("url").alias("file_path"), F.lit("U").alias("op"), F.lit("c1").alias("commit_hash"), F.encode("html", "UTF-8").alias("content"))
    return [rows.where("seq % 2 = 0"), rows.withColumn("op", F.when(F.col("seq") % 11 == 0, "D").otherwise("U"))]


def _ingested(spark: SparkSession, d: str) -> tuple[dict, DataFrame]:
    """The second batch applied to the store that the first has filled."""
    one, two = _files(spark, d)
    first, _ = ingest.apply({t: spark.createDataFrame([], schema.TABLES[t]) for t in changes.STATEFUL}, one)
    return ingest.apply({t: session.checkpointed(df) for t, df in first.items()}, two)


_NODE = ("id", "file_path", "byte_start", "byte_end", "simhash", "is_active")


@query
def q_ingest(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(spark, d)[0]["nodes"].select(*_NODE, F.col("parse_confidence").cast("double").alias("parse_confidence"))


@query
def q_stats(spark: SparkSession, d: str) -> DataFrame:
    """The counters of the second run."""
    return _ingested(spark, d)[1]


@query
def q_match(spark: SparkSession, d: str) -> DataFrame:
    """Documents as functions of their sources: shapes that the first half holds are found there or elsewhere."""
    n = session.checkpointed(nodes(spark, d).withColumn("n", F.col("id").cast("long")))
    held = n.where("n % 2 = 0").drop("n")
    spans = n.select(F.col("n").alias("seq"), "file_path", F.lit(0).alias("pos"), "simhash", F.lit(1.0).cast("float").alias("parse_confidence"))
    return ingest.match(spans, held).select("seq", "id", "is_new", "renamed_from")


@query
def q_parse_errors(spark: SparkSession, d: str) -> DataFrame:
    """Pages as Python files: none of them parses, each is one span of low confidence with an error."""
    p = read(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".py")).alias("file_path"), F.col("page_id").alias("seq"), F.lit("U").alias("op"), F.lit("c").alias("commit_hash"), F.encode("html", "UTF-8").alias("content"))
    after, _ = ingest.apply({t: spark.createDataFrame([], schema.TABLES[t]) for t in changes.STATEFUL}, p)
    return after["errors"].select("path", (F.length("message") > 0).alias("said"))


#: A batch of changes is every file that has arrived: of several changes to a path in it, the last one counts.
ALL_FILES = 1 << 20


@query
def q_stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The same changes as a stream of two batches of files, applied to a store; taken again with nothing new."""
    base = f"{session.work_folder(spark)}/ingest-{uuid.uuid4().hex}"
    st = store.Store(spark, f"{base}/store")
    for part in _files(spark, d):
        part.select(*changes.CHANGE.fieldNames()).write.mode("append").parquet(f"{base}/in")
        changes.run(spark, f"{base}/in", st, f"{base}/checkpoint", ALL_FILES)
    changes.run(spark, f"{base}/in", st, f"{base}/checkpoint", ALL_FILES)
    return st.read("nodes").select(*_NODE)


# --- the question path


def _corpus(spark: SparkSession, d: str) -> tuple[dict, DataFrame]:
    """Documents as a stored code base and its files."""
    docs = read(spark, d, "documents")
    v = text.embed(docs.select("doc_id", "text"), "text").select(F.col("doc_id").cast("string").alias("id"), "vector")
    n = nodes(spark, d).withColumn("file_path", F.concat(F.lit("doc/"), "id"))
    tables = {"nodes": n, "edges": session.checkpointed(following(spark, d)), "alias": spark.createDataFrame([], schema.ALIAS), "vectors": v, "traces": spark.createDataFrame([], schema.TRACES)}
    now = docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return tables, now


@query
def q_question(spark: SparkSession, d: str) -> DataFrame:
    """A question through the whole path: seed, walks, fusion, nodes, diverse choice, live text."""
    built = retrieve.build(*_corpus(spark, d), QUESTION, created_at=1)
    got = built.request.select(F.posexplode("context").alias("pos", "c"))
    return got.select("pos", F.col("c.nodeId").alias("node_id"), F.col("c.filePath").alias("file_path"), F.sha2("c.codeSnippet", 256).alias("snippet_sha256"), F.col("c.uncertain").alias("uncertain"))


@query
def q_question_trace(spark: SparkSession, d: str) -> DataFrame:
    """What the question leaves behind: the ids of its nodes, in the order of the walk."""
    built = retrieve.build(*_corpus(spark, d), QUESTION, created_at=1)
    return built.traces.select(F.array_join("node_ids", ",").alias("node_ids"), "created_at")


@query
def q_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers by a model that cites well, one that does not, one that says nothing, and a question without a match."""
    tables, now = _corpus(spark, d)
    first = tables["nodes"].agg(F.min("id")).first()[0]
    asked = [("cited", QUESTION, lambda system, user: CITED.format(first)), ("wrong", QUESTION, lambda system, user: UNCITED), ("silent", QUESTION, lambda system, user: ""), ("none", "what is the", None)]
    rows = []
    for name, question, model in asked:
        a = retrieve.answer(tables, now, question, model, created_at=1)
        rows.append((name, a["ok"], a["reason"], a["verified"], a["text"] if a["verified"] is not None else None))
    return spark.createDataFrame(rows, "case string, ok boolean, reason string, verified boolean, text string")


@query
def q_any_low(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.any_low(nodes(spark, d), ["file_path"])


# --- records


@query
def q_escape(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    said = F.concat(F.lit('a\\b "'), F.coalesce("text", F.lit("")), F.lit('"\n'))
    return c.select("conv_id", "turn", F.sha2(wire.escape(said), 256).alias("escaped_sha256"))


@query
def q_model_answer(spark: SparkSession, d: str) -> DataFrame:
    """The three shapes of a reply, and one without an answer."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("content"))
    said = F.struct("content")
    shapes = [F.to_json(F.struct(said.alias("message"))), F.to_json(F.struct(F.array(F.struct(said.alias("message"))).alias("choices"))), F.to_json(said), F.lit('{"error": 1}')]
    kind = F.col("turn") % 4
    json = F.when(kind == 0, shapes[0]).when(kind == 1, shapes[1]).when(kind == 2, shapes[2]).otherwise(shapes[3])
    return c.select("conv_id", "turn", F.sha2(wire.model_answer(json), 256).alias("answer_sha256"))


@query
def q_weighted_simhash(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of weighted tokens: each user's event types by how often they occur."""
    e = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("weight"))
    t = e.groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("text"), "weight")).alias("t"))
    return t.select("user_id", text.simhash_tokens(F.col("t")).alias("simhash"))


@query
def q_request(spark: SparkSession, d: str) -> DataFrame:
    """What a model is asked about each conversation: all of its texts, each under its id, and the question."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    node = F.struct(F.col("turn").cast("string").alias("nodeId"), F.col("role").alias("filePath"), F.col("text").alias("codeSnippet"), (F.col("role") == "system").alias("uncertain"))
    r = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", node.alias("n")))), lambda x: x["n"]).alias("context"))
    asked = retrieve.prompt(r.select(F.col("conv_id").cast("string").alias("traceId"), F.lit("why").alias("userQuery"), "context"))
    tail = F.substring_index("system", "\n\nFile ", -1)
    return asked.select(F.col("traceId").cast("long").alias("conv_id"), "user", F.sha2(tail, 256).alias("last_sha256"), wire.citations(F.regexp_replace("system", r"\[node:ID\]", "")).alias("ids")).select("conv_id", "user", "last_sha256", F.size("ids").cast("long").alias("n_ids"))
