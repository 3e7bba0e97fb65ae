"""Registered queries of the engine, each with the SQL that DuckDB must agree with (``oracle.py``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema, session
from ..functions import hashing, text, wire
from ..operators import alias, graph, ingest, store, vectors
from ..sources import git
from ..streaming import changes
from . import code_queries, path_queries, retrieve  # noqa: F401  the first two register their own
from .oracle import ORACLE_SQL  # noqa: F401
from .projections import buys, nodes, prints, read, same, supplied, tagged, trade
from .registry import QUERIES, query  # noqa: F401
from .retrieve_text import QUESTION


@query
def q_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"), text.content_tokens(F.col("text")).alias("c"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size("c").cast("long").alias("n_content"))


@query
def q_fnv(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("token")).distinct()
    return words.select("token", hashing.fnv1a(F.col("token")).alias("hash"))


@query
def q_namespace(spark: SparkSession, d: str) -> DataFrame:
    roots = read(spark, d, "documents").select("source").distinct()
    return roots.select("source", hashing.namespace(F.concat(F.lit("/"), "source")).alias("socket"))


@query
def q_embed_sparse(spark: SparkSession, d: str) -> DataFrame:
    e = text.embed_sparse(read(spark, d, "documents").select("doc_id", "text"), "text")
    return e.select("doc_id", F.explode("embedding").alias("e")).select("doc_id", F.col("e.bucket").alias("bucket"), F.col("e.v").cast("long").alias("v"))


@query
def q_embed_norm(spark: SparkSession, d: str) -> DataFrame:
    e = text.embed_sparse(read(spark, d, "documents").select("doc_id", "text"), "text")
    return e.select("doc_id", F.round(text.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").cast("long").alias("n_nonzero"))


@query
def q_ask_topk(spark: SparkSession, d: str) -> DataFrame:
    best = vectors.top_k_text(read(spark, d, "documents"), QUESTION, retrieve.SEEDS, "doc_id", "text")
    return best.where(F.col("score") >= retrieve.FLOOR).select("doc_id", F.round("score", 6).alias("score"))


@query
def q_vec_topk(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()
    return vectors.top_k(e, list(q.embedding) if q else [], 10, "vec_id", "embedding").select("vec_id", F.round("score", 6).alias("score"))


@query
def q_vec_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return vectors.top_k_batch(e, q, 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query
def q_simhash(spark: SparkSession, d: str) -> DataFrame:
    return prints(spark, d).select("doc_id", "simhash")


@query
def q_simhash_match(spark: SparkSession, d: str) -> DataFrame:
    """The node that each document's fingerprint finds anywhere, and the one that it finds in its own file."""
    n = session.checkpointed(nodes(spark, d))
    anywhere = store.by_simhash(n, n, False).withColumnRenamed("id", "match_id")
    same = store.by_simhash(n, n, True).withColumnRenamed("id", "same_file_id")
    return n.select("id", "simhash", "file_path").join(anywhere, "simhash").join(same, ["simhash", "file_path"]).select("id", "match_id", "same_file_id")


@query
def q_hamming(spark: SparkSession, d: str) -> DataFrame:
    p = session.checkpointed(prints(spark, d).select("doc_id", "simhash"))
    q = p.select((F.col("doc_id") - 1).alias("_before"), F.col("simhash").alias("_next"))
    return p.join(q, p.doc_id == q._before).select("doc_id", text.hamming(F.col("simhash"), F.col("_next")).alias("distance"))


@query
def q_rename_alias(spark: SparkSession, d: str) -> DataFrame:
    p = session.checkpointed(prints(spark, d).select("doc_id", "simhash"))
    w = Window.partitionBy("simhash").orderBy("doc_id")
    pairs = p.select(F.col("doc_id").cast("string").alias("old_id"), F.lead("doc_id").over(w).cast("string").alias("new_id")).where("new_id IS NOT NULL")
    return pairs.join(alias.closure(pairs), "old_id").select(F.col("old_id").cast("long").alias("old_id"), F.col("new_id").cast("long").alias("new_id"), F.col("root_id").cast("long").alias("root_id"))


@query
def q_alias_chain(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", "turn").distinct()
    w = Window.partitionBy("conv_id").orderBy("turn")
    key = lambda t: F.concat_ws("/", F.col("conv_id").cast("string"), t.cast("string"))
    pairs = c.select(key(F.col("turn")).alias("old_id"), key(F.lead("turn").over(w)).alias("new_id"), F.lead("turn").over(w).alias("n")).where("n IS NOT NULL").drop("n")
    return alias.closure(pairs).select("old_id", "root_id")


@query
def q_upsert_lww(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("seq"), "event_id", "event_type", F.round("value", 6).alias("value"))
    return store.latest(e, ["user_id"], "seq").select("user_id", "event_id", "event_type", "value")


@query
def q_tombstone(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    n = p.select(tagged("p", F.col("p_partkey")).alias("id"), F.lit(True).alias("is_active"))
    dead = p.where("p_size < 5").select(tagged("p", F.col("p_partkey")).alias("id"))
    _, left = store.tombstone(n, trade(spark, d), dead)
    return left.select("source_id", "target_id", "weight")


@query
def q_tombstone_nodes(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    n = p.select(tagged("p", F.col("p_partkey")).alias("id"), F.lit(True).alias("is_active"))
    marked, _ = store.tombstone(n, supplied(spark, d), p.where("p_size < 5").select(tagged("p", F.col("p_partkey")).alias("id")))
    return marked.select("id", "is_active")


@query
def q_edge_fk(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").where("c_acctbal > 0").select(tagged("c", F.col("c_custkey")).alias("id"))
    p = read(spark, d, "part").where("p_size < 40").select(tagged("p", F.col("p_partkey")).alias("id"))
    return store.with_ends(buys(spark, d), c.union(p)).select("source_id", "target_id", "weight")


@query
def q_history(spark: SparkSession, d: str) -> DataFrame:
    """Half of the orders are in the table with an older message; all are recorded over them."""
    o = read(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("node_id"), F.col("o_orderkey").alias("key"), F.col("o_orderkey").cast("string").alias("commit_hash"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority")).alias("synthetic_msg"),
    )
    rows = o.select("node_id", "commit_hash", F.floor(F.col("us") / 1_000_000).cast("long").alias("timestamp"), "synthetic_msg", "key")
    before = rows.where("key % 2 = 0").withColumn("synthetic_msg", F.lit("older"))
    return store.record_history(before.drop("key"), rows.where("key % 3 <> 0").drop("key"))


@query
def q_diff(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    month = lambda y: li.where(F.year("l_shipdate") == y).groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    return git.diff(month(1995), month(1996), ["l_partkey"], "q")


@query
def q_out_edges(spark: SparkSession, d: str) -> DataFrame:
    e = trade(spark, d)
    s = graph.out_stats(e).withColumnRenamed("source_id", "_s")
    return e.join(s, F.col("source_id") == F.col("_s")).select("source_id", "target_id", F.round(F.col("weight") / F.col("out_weight"), 9).alias("share"), F.col("out_degree").cast("long").alias("out_degree"))


@query
def q_resolved_edges(spark: SparkSession, d: str) -> DataFrame:
    """Part ids divisible by ten are renamed to their successors; parallel edges stay apart."""
    a = read(spark, d, "part").where("p_partkey % 10 = 0").select(tagged("p", F.col("p_partkey")).alias("old_id"), tagged("p", F.col("p_partkey") + 1).alias("root_id"))
    return graph.out_edges(buys(spark, d), a).groupBy("target_id").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query
def q_rrf(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_brand").alias("seed_brand"), F.col("p_partkey").alias("id"), "p_retailprice", "p_size")
    lists = [graph.ranked(p.select("seed_brand", "id", F.col(c).alias("score")), ["seed_brand"]) for c in ("p_retailprice", "p_size")]
    return graph.fuse(lists, ["seed_brand"]).select(F.col("id").alias("p_partkey"), F.round("score", 9).alias("score"))


@query
def q_topo_jaccard(spark: SparkSession, d: str) -> DataFrame:
    adj = session.checkpointed(graph.adjacency(supplied(spark, d)).where("id LIKE 's:%'").withColumn("n", F.substring("id", 3, 20).cast("long")))
    b = adj.select((F.col("n") - 1).alias("_n"), F.col("id").alias("b"), F.col("neighbours").alias("nb"))
    return adj.join(b, adj.n == b._n).select(F.col("id").alias("a"), "b", F.round(graph.redundancy(F.col("id"), F.col("neighbours"), F.col("b"), F.col("nb")), 9).alias("redundancy"))


@query
def q_snippet(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    cut = wire.byte_slice(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.lit(11).cast("long"), F.lit(61).cast("long"))
    return docs.select("doc_id", F.lower(F.hex(cut)).alias("bytes"))


@query
def q_citations(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    said = F.concat(F.lit("x [node:"), F.col("a").cast("string"), F.lit("] y [node:"), F.col("b").cast("string"), F.lit("] [node:"), F.col("a").cast("string"), F.lit("] [node:] [node:z"))
    answers = e.select(F.col("user_id").alias("answer_id"), said.alias("text"))
    known = read(spark, d, "events").where("event_id % 3 <> 0").select(F.col("event_id").cast("string").alias("id"))
    got = retrieve.verify(answers, known)
    return got.select("answer_id", "all_valid", F.array_join("invalid_ids", ",").alias("invalid_ids"))


@query
def q_trace_json(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", "turn").distinct()
    ids = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    json = ids.select("conv_id", F.to_json(F.transform("t", lambda x: F.concat(F.lit("n"), x.cast("string")))).alias("node_ids_json"))
    return json.select("conv_id", "node_ids_json", F.posexplode(wire.id_array(F.col("node_ids_json"))).alias("pos", "node_id"))


@query
def q_render(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = nodes(spark, d).withColumn("rank", F.col("id").cast("long"))
    shown = n.join(docs, n.rank == docs.doc_id).withColumn("snippet", F.col("text")).drop("doc_id", "text")
    near = same(spark, d).select("source_id", "target_id", "type")
    return retrieve.render_blocks(shown, near).select("id", F.sha2("block", 256).alias("block_sha256"))


@query
def q_request_json(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    node = F.struct(F.col("turn").cast("string").alias("nodeId"), F.col("role").alias("filePath"), F.col("text").alias("codeSnippet"), (F.col("role") == "system").alias("uncertain"))
    r = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", node.alias("n")))), lambda x: x["n"]).alias("context"))
    sent = r.select("conv_id", wire.encode_request(F.struct(F.col("conv_id").cast("string").alias("traceId"), F.lit('say "hi"\n').alias("userQuery"), F.lit(True).alias("requireCitations"), "context")).alias("j"))
    back = sent.select("conv_id", wire.decode_request(F.col("j")).alias("r"))
    return back.select(
        "conv_id", F.col("r.traceId").alias("trace_id"), F.col("r.userQuery").alias("user_query"), F.size("r.context").cast("long").alias("n_nodes"),
        F.size(F.filter("r.context", lambda x: x["uncertain"])).cast("long").alias("n_uncertain"), F.sha2(F.array_join(F.transform("r.context", lambda x: x["codeSnippet"]), "|"), 256).alias("snippets_sha256"),
    )


@query
def q_chunk_json(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", F.struct(F.col("user_id").cast("string").alias("traceId"), F.concat(F.col("event_type"), F.lit('"\\\n')).alias("textDelta"), (F.col("event_id") % 2 == 0).alias("done"), F.lit(False).alias("unverifiedCitation")).alias("c"))
    back = e.select("event_id", wire.decode_chunk(wire.encode_chunk(F.col("c"))).alias("c"))
    return back.select("event_id", F.col("c.traceId").alias("trace_id"), F.col("c.textDelta").alias("text_delta"), F.col("c.done").alias("done"))


@query
def q_props_field(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select("event_id", wire.string_field(F.col("props"), "k").alias("k"), wire.bool_field(F.col("props"), "missing", True).alias("flag"))


@query
def q_stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    base = f"{session.work_folder(spark)}/stream-{uuid.uuid4().hex}"
    e = read(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    e.repartitionByRange(4, "event_id").write.parquet(f"{base}/in")
    out = changes.upsert_stream(spark, f"{base}/in", e.schema, ["user_id"], ["ts", "event_id"], f"{base}/state", f"{base}/checkpoint")
    return out.select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))
