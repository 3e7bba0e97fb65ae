"""The question path: seed search, expansion, fusion, diverse choice, live text, trace, and the check of an answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import text, wire
from ..operators import graph, store, vectors
from .retrieve_text import RULE, THIN

SEEDS = 5
CONTEXT_NODES = 10
FLOOR = 0.05
DEFAULT_RELEVANCE = 0.5
#: What a caller is told.
NO_MATCH = "I couldn't find matching concepts in the codebase. Are you referring to an external library?"
NO_EDGES = "Found a semantic match but it has no recorded structural edges yet."
UNCERTAIN = "Structural resolution is uncertain in this region."
UNVERIFIED = "[Unverified] This answer contains citations that do not match the stored nodes."


@dataclass
class Built:
    """ok, or the reason why not; nodes (rank, …) and edges of the trace; the request as one row."""

    ok: bool
    reason: str = ""
    trace_id: str = ""
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    request: DataFrame | None = None
    traces: DataFrame | None = None


def hydrate(ranked: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with the ranks of ``ranked`` (id, rank, …), out-edges of these); unknown ids drop out.

    A question's list is a budget long and a batch of them that many times as long; the join follows the size.
    """
    kept = nodes.join(ranked, "id").withColumn("uncertain", wire.uncertain(F.col("parse_confidence")))
    out = edges.join(kept.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
    return kept, out


def any_low(nodes: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by…, any_low_confidence): one row, or one for each group."""
    return nodes.groupBy(*by).agg(F.coalesce(F.bool_or(F.col("parse_confidence") < schema.LOW_CONFIDENCE), F.lit(False)).alias("any_low_confidence"))


def snippets(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``nodes`` with ``snippet``: the bytes that the file holds now in the node's range, as text; "" without.

    A file may have changed since, so a range can cut a character; what is no UTF-8 becomes the replacement character.
    """
    f = files.select("file_path", "content").join(nodes.select("file_path").distinct(), "file_path", "left_semi")  # no other file moves
    got = nodes.join(f, "file_path", "left")
    cut = wire.byte_slice(F.coalesce("content", F.lit(b"")), F.col("byte_start"), F.col("byte_end"))
    return got.withColumn("snippet", F.make_valid_utf8(cut.cast("string"))).drop("content")


def trace_id_of(question: str, version: int = 0) -> str:
    import hashlib

    return hashlib.sha256(f"{version}\x1f{question}".encode()).hexdigest()[:32]


def build(
    tables: dict[str, DataFrame], files: DataFrame, question: str, budget: int = graph.BUDGET, context_nodes: int = CONTEXT_NODES, floor: float = FLOOR, created_at: int | None = None, version: int = 0
) -> Built:
    """The whole question path over tables (nodes, edges, alias, vectors, traces) and files (file_path, content)."""
    nodes, edges, alias = tables["nodes"], tables["edges"], tables["alias"]
    spark = nodes.sparkSession
    row = text.embed(spark.createDataFrame([(question,)], "q string"), "q", "v").first()
    seeds = vectors.top_k(tables["vectors"], list(row.v), SEEDS).collect()  # five rows
    if not seeds or seeds[0].score < floor:
        return Built(False, NO_MATCH)
    start = spark.createDataFrame([(seeds[0].id,)], "seed string")
    ranked = graph.session.checkpointed(graph.dual_horizon(graph.out_edges(edges, alias), start, budget, 1).select("id", "rank"))
    kept, out = hydrate(ranked, nodes, edges)
    kept, out = graph.session.checkpointed(kept), graph.session.checkpointed(out)
    if kept.isEmpty():
        return Built(False, NO_EDGES)
    scores = spark.createDataFrame([(s.id, float(s.score)) for s in seeds], "id string, score double")
    candidates = kept.join(F.broadcast(scores), "id", "left").select(F.lit(0).alias("query_id"), "id", F.coalesce("score", F.lit(DEFAULT_RELEVANCE)).alias("relevance"), "rank")
    chosen = graph.mmr(candidates, out, context_nodes)
    context = snippets(kept.join(F.broadcast(chosen.select("id", "pick")), "id"), files)
    trace_id = trace_id_of(question, version)
    node = F.struct(F.col("id").alias("nodeId"), F.col("file_path").alias("filePath"), F.col("snippet").alias("codeSnippet"), "uncertain")
    request = context.agg(F.transform(F.array_sort(F.collect_list(F.struct("pick", node.alias("n")))), lambda x: x["n"]).alias("context")).select(
        F.lit(trace_id).alias("traceId"), F.lit(question).alias("userQuery"), F.lit(True).alias("requireCitations"), "context"
    )
    traces = store.record_trace(tables["traces"], trace_id, kept.select("id", "rank"), created_at)
    return Built(True, "", trace_id, kept, out, request, traces)


@dataclass
class Batch:
    """Of many questions: requests (query_id, and a request's fields), trace rows, and refused questions (query_id, reason)."""

    requests: DataFrame
    traces: DataFrame
    refused: DataFrame


def build_batch(
    tables: dict[str, DataFrame], files: DataFrame, questions: DataFrame, budget: int = graph.BUDGET, context_nodes: int = CONTEXT_NODES, floor: float = FLOOR, created_at: int | None = None, version: int = 0
) -> Batch:
    """``build`` for every row of ``questions`` (query_id, question) in one plan: one search, one set of walks, one choice.

    Each question's rows carry its id, so what one finds does not touch another.  Walks from one seed are walked once.  A
    null question matches nothing.  Nothing but the questions' vectors passes through the driver, in counted blocks.
    """
    nodes, edges = tables["nodes"], tables["edges"]
    asked = questions.select("query_id", "question")
    v = text.embed(asked, "question", "query").select("query_id", "query")
    best = graph.session.checkpointed(vectors.top_k_batch(tables["vectors"], v, SEEDS))
    seeds = best.where((F.col("rank") == 1) & (F.col("score") >= floor)).select("query_id", F.col("id").alias("seed"))
    lists = graph.dual_horizon(graph.out_edges(edges, tables["alias"]), seeds.select("seed"), budget).select("seed", "id", "rank")
    ranked = graph.session.checkpointed(seeds.join(lists, "seed").select("query_id", "id", "rank"))
    kept = graph.session.checkpointed(nodes.join(ranked, "id").withColumn("uncertain", wire.uncertain(F.col("parse_confidence"))))
    out = edges.join(kept.select("query_id", F.col("id").alias("source_id")), "source_id").select("query_id", "source_id", "target_id", "type", "weight")
    candidates = kept.join(best.select("query_id", "id", "score"), ["query_id", "id"], "left").select("query_id", "id", F.coalesce("score", F.lit(DEFAULT_RELEVANCE)).alias("relevance"), "rank")
    chosen = graph.mmr(candidates, out, context_nodes)
    context = snippets(kept.join(chosen.select("query_id", "id", "pick"), ["query_id", "id"]), files)
    node = F.struct(F.col("id").alias("nodeId"), F.col("file_path").alias("filePath"), F.col("snippet").alias("codeSnippet"), "uncertain")
    told = context.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pick", node.alias("n")))), lambda x: x["n"]).alias("context"))
    trace = F.substring(F.sha2(F.concat(F.lit(f"{version}\x1f"), "question"), 256), 1, 32)
    requests = asked.join(told, "query_id").select("query_id", trace.alias("traceId"), F.col("question").alias("userQuery"), F.lit(True).alias("requireCitations"), "context")
    traces = store.trace_rows(asked.select("query_id", trace.alias("trace_id")).join(kept, "query_id").select("trace_id", "id", "rank").distinct(), created_at)
    some = kept.select("query_id", F.lit(True).alias("_any")).distinct()
    found = asked.select("query_id").join(seeds, "query_id", "left").join(some, "query_id", "left")
    refused = found.where("_any IS NULL").select("query_id", F.when(F.col("seed").isNull(), NO_MATCH).otherwise(NO_EDGES).alias("reason"))
    return Batch(requests, traces, refused)


def replay(traces: DataFrame, trace_id: str, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (with rank) and edges of a stored trace as they are now; an unknown trace has none."""
    ids = traces.where(F.col("trace_id") == trace_id).select(F.posexplode("node_ids").alias("rank", "id"))
    return hydrate(ids, nodes, edges)


def replay_all(traces: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (trace_id, rank, …) and edges of all ``traces`` as they are now."""
    return hydrate(traces.select("trace_id", F.posexplode("node_ids").alias("rank", "id")), nodes, edges)


#: Fixed value: the head of a node's links in a rendered trace.
LINKS = "\n  [Outgoing Calls / Relationships]\n"


def block(id_: Column, path: Column, confidence: Column, snippet: Column, links: Column) -> Column:
    """One node of a rendered trace; links: array of (type, target)."""
    body = F.when((F.length(snippet) > 0) & ~F.endswith(snippet, F.lit("\n")), F.concat(snippet, F.lit("\n"))).otherwise(snippet)
    arrows = F.array_join(F.transform(links, lambda e: F.concat(F.lit("  -> "), e["type"], F.lit(" "), wire.short_id(e["target_id"]), F.lit("...\n"))), "")
    return F.concat(
        F.lit(f"\n{RULE}\nFILE: "), path, F.lit("  ["), wire.short_id(id_), F.lit("...]\nCONFIDENCE: "), wire.confidence_label(confidence),
        F.lit(f"\n{THIN}\n"), body, F.lit(f"{RULE}\n"), F.when(F.size(links) > 0, F.concat(F.lit(LINKS), arrows)).otherwise(""),
    )


def render_blocks(nodes: DataFrame, edges: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by…, rank, id, block) of the active nodes (id, rank, file_path, parse_confidence, snippet, is_active)."""
    links = edges.groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("target_id", "type"))).alias("links"))
    none = F.array().cast("array<struct<target_id:string,type:string>>")
    met = nodes.where("is_active").join(links, "id", "left").withColumn("links", F.coalesce("links", none))
    return met.select(*by, "rank", "id", block(F.col("id"), F.col("file_path"), F.col("parse_confidence"), F.col("snippet"), F.col("links")).alias("block"))


def render(nodes: DataFrame, edges: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """One row, ``text``: the trace as a reader sees it; "" for an empty trace.  ``by``: a row for each group, as of many
    traces.  A trace has at most a budget of nodes."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "")
    blocks, low = render_blocks(nodes, edges, by).groupBy(*by).agg(body.alias("body")), any_low(nodes, by)
    met = low.join(blocks, by, "left") if by else low.crossJoin(blocks)  # a row each
    return met.select(*by, F.concat(F.when(F.col("any_low_confidence"), F.lit(UNCERTAIN + "\n\n")).otherwise(""), F.coalesce("body", F.lit(""))).alias("text"))


def verify(answers: DataFrame, nodes: DataFrame, id_col: str = "answer_id", text_col: str = "text") -> DataFrame:
    """(id, all_valid, invalid_ids): every citation must name a node, active or not; invalid ids in order of first use."""
    cited = answers.select(id_col, F.posexplode_outer(wire.citations(F.col(text_col))).alias("pos", "cited"))
    known = nodes.select(F.col("id").alias("cited")).distinct()
    bad = cited.where("cited IS NOT NULL").join(known, "cited", "left_anti")
    wrong = bad.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cited"))), lambda x: x["cited"]).alias("invalid_ids"))
    none = F.array().cast("array<string>")
    return answers.select(id_col).join(wrong, id_col, "left").select(id_col, F.col("invalid_ids").isNull().alias("all_valid"), F.coalesce("invalid_ids", none).alias("invalid_ids"))


def prompt(request: DataFrame) -> DataFrame:
    """(traceId, system, user): what a language model is asked, from request rows."""
    head = (
        "You are given excerpts of a code base, each under a line with its file and its id. They are all that you know about it. "
        "Write [node:ID] after each sentence that says something about the code, where ID is the id of the excerpt that shows it; "
        "a program looks these ids up, and an unknown one marks your reply as unverified. Say so if the excerpts do not answer the question. "
        f'Should an excerpt carry the line (uncertain), let your reply start with this sentence: "{UNCERTAIN}"\n\n'
    )
    parts = F.transform("context", lambda c: F.concat(F.lit("File "), c["filePath"], F.lit(" [node:"), c["nodeId"], F.lit("]\n"), F.when(c["uncertain"], F.lit("(uncertain)\n")).otherwise(""), c["codeSnippet"], F.lit("\n\n")))
    return request.select("traceId", F.concat(F.lit(head), F.array_join(parts, "")).alias("system"), F.col("userQuery").alias("user"))


def answer(tables: dict[str, DataFrame], files: DataFrame, question: str, synthesize: Callable[[str, str], str] | None = None, trace_only: bool = False, **options) -> dict:
    """Build, ask ``synthesize`` (system, user) if there is one, verify its citations; without an answer the rendered
    trace.  Keys: ok, reason, trace_id, text, verified."""
    built = build(tables, files, question, **options)
    if not built.ok:
        return {"ok": False, "reason": built.reason, "trace_id": "", "text": "", "verified": None}
    said = ""
    if synthesize and not trace_only:
        row = prompt(built.request).first()
        said = synthesize(row.system, row.user) or ""
    if not said:
        shown = render(snippets(built.nodes, files), built.edges).first().text
        return {"ok": True, "reason": "", "trace_id": built.trace_id, "text": shown, "verified": None}
    spark = built.nodes.sparkSession
    checked = verify(spark.createDataFrame([("a", said)], "answer_id string, text string"), tables["nodes"]).first()
    note = "" if checked.all_valid else "\n" + UNVERIFIED
    return {"ok": True, "reason": "", "trace_id": built.trace_id, "text": said + note, "verified": checked.all_valid}
