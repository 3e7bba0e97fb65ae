"""DuckDB SQL that computes the registered queries independently, on the same tables."""

from __future__ import annotations

from ..functions.text import STOP_WORDS
from .oracle_code import code
from .oracle_paths import _RENAMES, paths
from .retrieve_text import QUESTION, RULE, THIN

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: The byte hash of a non-empty ASCII token, unsigned and as a signed number.
_FNV = "list_reduce([1469598103934665603::UHUGEINT] || list_transform(string_split({0}, ''), lambda c: ascii(c)::UHUGEINT), lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
_SIGNED = "({0})::UBIGINT::BIT::BIGINT"
_TOK = "list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9]+'), lambda t: lower(t))"
_WORDS = f"""tok AS (SELECT doc_id, unnest({_TOK.format("text")}) t FROM documents),
hashed AS (SELECT t, {_FNV.format("t")} h FROM (SELECT DISTINCT t FROM tok))"""
_SPARSE = f"""{_WORDS},
sparse AS (SELECT doc_id, (h % 384)::INT bucket, sum(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN -1 ELSE 1 END)::BIGINT v
FROM tok JOIN hashed USING (t) WHERE t NOT IN ({_STOP}) GROUP BY ALL HAVING v <> 0)"""
_PRINTS = f"""{_WORDS},
votes AS (SELECT doc_id, b, sum(CASE WHEN (h::UBIGINT >> b) & 1 = 1 THEN 1 ELSE -1 END) s FROM tok JOIN hashed USING (t), range(64) r(b) GROUP BY ALL),
prints AS (SELECT d.doc_id, d.lang, d.source, d.text, coalesce(p, 0)::UBIGINT::BIT::BIGINT simhash
FROM documents d LEFT JOIN (SELECT doc_id, bit_or(1::UBIGINT << b::INT) p FROM votes WHERE s > 0 GROUP BY doc_id) USING (doc_id))"""
_BUYS = """buys AS (SELECT 'c:' || o_custkey source_id, 'p:' || l_partkey target_id, count(*)::DOUBLE weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""
_SUPPLIED = """supplied AS (SELECT 'p:' || l_partkey source_id, 's:' || l_suppkey target_id, count(*)::DOUBLE weight FROM lineitem GROUP BY ALL)"""
_TRADE = f"{_BUYS}, {_SUPPLIED}, trade AS (SELECT * FROM buys UNION ALL SELECT * FROM supplied)"
_MATCH = f"{_PRINTS}, least AS (SELECT simhash, min(doc_id) match_id FROM prints GROUP BY simhash), matched AS (SELECT doc_id, match_id, simhash FROM prints JOIN least USING (simhash))"
_NODES = "nodes AS (SELECT p.doc_id, p.doc_id::VARCHAR id, source file_path, strlen(p.text)::BIGINT byte_end, coalesce(quality, 0) conf, p.text FROM prints p LEFT JOIN labels l ON l.doc_id = p.doc_id)"
_HREF = "href AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href=\"([^\"]*)\"', 1)) h FROM pages)"
_Q = f"""q AS (SELECT ({_FNV.format("t")} % 384)::INT bucket, sum(CASE WHEN {_FNV.format("t")} >= 9223372036854775808::UHUGEINT THEN -1 ELSE 1 END)::BIGINT w
FROM (SELECT unnest({_TOK.format("'" + QUESTION + "'")}) t) WHERE t NOT IN ({_STOP}) GROUP BY 1)"""
_COS = "CASE WHEN n1 * n2 > 0 THEN d / (n1 * n2) ELSE 0 END"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"

ORACLE_SQL: dict[str, str] = {
    "q_tokens": f"SELECT doc_id, len(t)::BIGINT n_tokens, len(list_filter(t, lambda x: x NOT IN ({_STOP})))::BIGINT n_content FROM (SELECT doc_id, {_TOK.format('text')} t FROM documents)",
    "q_fnv": f"WITH {_WORDS} SELECT t AS token, {_SIGNED.format('h')} AS hash FROM hashed",
    "q_namespace": f"SELECT source, '/tmp/trailhead-' || lower(to_hex(({_FNV.format(chr(39) + '/' + chr(39) + ' || source')})::UBIGINT)) || '.sock' socket FROM (SELECT DISTINCT source FROM documents)",
    "q_embed_sparse": f"WITH {_SPARSE} SELECT * FROM sparse",
    "q_embed_norm": f"WITH {_SPARSE} SELECT d.doc_id, round(coalesce(sqrt(sum(v * v)::DOUBLE), 0), 6) norm, count(v)::BIGINT n_nonzero FROM documents d LEFT JOIN sparse USING (doc_id) GROUP BY d.doc_id",
    "q_ask_topk": f"""WITH {_SPARSE}, {_Q}, size AS (SELECT sqrt(sum(w * w)::DOUBLE) n2 FROM q),
s AS (SELECT doc_id, sqrt(sum(v * v)::DOUBLE) n1, sum(v * coalesce(w, 0))::DOUBLE d FROM sparse LEFT JOIN q USING (bucket) GROUP BY doc_id),
top AS (SELECT doc_id, {_COS} score FROM s, size ORDER BY score DESC, doc_id LIMIT 5)
SELECT doc_id, round(score, 6) score FROM top WHERE score >= 0.05""",
    "q_vec_topk": f"""WITH x AS (SELECT e.vec_id, {_DOT.format('e.embedding', 'q.embedding')} d, sqrt({_DOT.format('e.embedding', 'e.embedding')}) n1, sqrt({_DOT.format('q.embedding', 'q.embedding')}) n2
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q), s AS (SELECT vec_id, {_COS} score FROM x ORDER BY score DESC, vec_id LIMIT 10)
SELECT vec_id, round(score, 6) score FROM s""",
    "q_vec_topk_batch": f"""WITH x AS (SELECT q.vec_id query_id, e.vec_id id, {_DOT.format('e.embedding', 'q.embedding')} d, sqrt({_DOT.format('e.embedding', 'e.embedding')}) n1, sqrt({_DOT.format('q.embedding', 'q.embedding')}) n2
FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) q), s AS (SELECT query_id, id, {_COS} score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT rank FROM s)
SELECT query_id, id, round(score, 6) score, rank FROM r WHERE rank <= 5""",
    "q_simhash": f"WITH {_PRINTS} SELECT doc_id, simhash FROM prints",
    "q_hamming": f"WITH {_PRINTS} SELECT a.doc_id, bit_count(xor(a.simhash, b.simhash))::INT distance FROM prints a JOIN prints b ON b.doc_id = a.doc_id + 1",
    "q_rename_alias": f"""WITH {_PRINTS}, n AS (SELECT doc_id old_id, lead(doc_id) OVER w new_id, max(doc_id) OVER (PARTITION BY simhash) root_id FROM prints WINDOW w AS (PARTITION BY simhash ORDER BY doc_id))
SELECT * FROM n WHERE new_id IS NOT NULL""",
    "q_alias_chain": "SELECT conv_id || '/' || turn old_id, conv_id || '/' || root root_id FROM (SELECT DISTINCT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) root FROM conversations) WHERE turn < root",
    "q_upsert_lww": "SELECT user_id, arg_max(event_id, (ts, event_id)) event_id, arg_max(event_type, (ts, event_id)) event_type, round(arg_max(value, (ts, event_id)), 6) value FROM events GROUP BY user_id",
    "q_tombstone": f"WITH {_TRADE}, dead AS (SELECT 'p:' || p_partkey id FROM part WHERE p_size < 5) SELECT * FROM trade WHERE source_id NOT IN (FROM dead) AND target_id NOT IN (FROM dead)",
    "q_tombstone_nodes": "SELECT 'p:' || p_partkey id, p_size >= 5 is_active FROM part",
    "q_edge_fk": f"""WITH {_BUYS}, n AS (SELECT 'c:' || c_custkey id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'p:' || p_partkey FROM part WHERE p_size < 40)
SELECT * FROM buys WHERE source_id IN (FROM n) AND target_id IN (FROM n)""",
    "q_diff": """WITH a AS (SELECT l_partkey, sum(l_quantity) q FROM lineitem WHERE year(l_shipdate) = 1995 GROUP BY 1), b AS (SELECT l_partkey, sum(l_quantity) q FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY 1)
SELECT coalesce(b.l_partkey, a.l_partkey) l_partkey, CASE WHEN a.l_partkey IS NULL THEN 'added' WHEN b.l_partkey IS NULL THEN 'deleted' ELSE 'modified' END status
FROM a FULL JOIN b ON a.l_partkey = b.l_partkey WHERE a.q IS DISTINCT FROM b.q""",
    "q_out_edges": f"WITH {_TRADE}, s AS (SELECT source_id, sum(weight) w, count(*)::BIGINT out_degree FROM trade GROUP BY 1) SELECT source_id, target_id, round(weight / w, 9) share, out_degree FROM trade JOIN s USING (source_id)",
    "q_resolved_edges": f"""WITH {_BUYS}, a AS (SELECT 'p:' || p_partkey old_id, 'p:' || (p_partkey + 1) root_id FROM part WHERE p_partkey % 10 = 0)
SELECT coalesce(root_id, target_id) target_id, count(*)::BIGINT n, sum(weight) weight FROM buys LEFT JOIN a ON target_id = old_id GROUP BY 1""",
    "q_rrf": """WITH a AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) x, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) y FROM part)
SELECT p_partkey, round(1.0::DOUBLE / (60 + x) + 1.0::DOUBLE / (60 + y), 9) score FROM a""",
    "q_topo_jaccard": """WITH s AS (SELECT DISTINCT l_suppkey s, l_partkey p FROM lineitem), n AS (SELECT s, count(*) c FROM s GROUP BY 1),
pair AS (SELECT a.s, count(*) k FROM s a JOIN s b ON b.s = a.s + 1 AND a.p = b.p GROUP BY 1)
SELECT 's:' || n.s a, 's:' || m.s b, round(coalesce(k, 0)::DOUBLE / (n.c + m.c - coalesce(k, 0)), 9) redundancy FROM n JOIN n m ON m.s = n.s + 1 LEFT JOIN pair ON pair.s = n.s""",
    "q_snippet": "SELECT doc_id, lower(substr(hex(encode(coalesce(text, ''))), 23, 100)) bytes FROM documents",
    "q_citations": """WITH e AS (SELECT user_id, min(event_id) a, max(event_id) b FROM events GROUP BY 1), k AS (SELECT event_id FROM events WHERE event_id % 3 <> 0),
c AS (SELECT user_id, unnest([a::VARCHAR, b::VARCHAR, '']) id, unnest([1, 2, 3]) p FROM e), f AS (SELECT user_id, id, min(p) p FROM c GROUP BY ALL),
bad AS (SELECT user_id, string_agg(id, ',' ORDER BY p) s FROM f WHERE id NOT IN (SELECT event_id::VARCHAR FROM k) GROUP BY 1)
SELECT e.user_id answer_id, s IS NULL all_valid, coalesce(s, '') invalid_ids FROM e LEFT JOIN bad USING (user_id)""",
    "q_trace_json": """WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations), j AS (SELECT conv_id, '[' || string_agg('"n' || turn || '"', ',' ORDER BY turn) || ']' node_ids_json FROM c GROUP BY 1)
SELECT c.conv_id, node_ids_json, (row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) - 1)::INT pos, 'n' || turn node_id FROM c JOIN j USING (conv_id)""",
    "q_render": f"""WITH {_MATCH}, {_NODES}, m AS (SELECT doc_id, match_id FROM matched WHERE doc_id <> match_id)
SELECT id, sha256(chr(10) || '{RULE}' || chr(10) || 'FILE: ' || file_path || '  [' || left(id, 8) || '...]' || chr(10) || 'CONFIDENCE: ' || CASE WHEN conf >= 0.5 THEN 'HIGH (Structured AST Node)' ELSE 'LOW (Whole-File Degrade)' END
|| chr(10) || '{THIN}' || chr(10) || coalesce(text, '') || CASE WHEN coalesce(text, '') <> '' AND right(text, 1) <> chr(10) THEN chr(10) ELSE '' END || '{RULE}' || chr(10)
|| CASE WHEN match_id IS NULL THEN '' ELSE chr(10) || '  [Outgoing Calls / Relationships]' || chr(10) || '  -> SAME ' || left(match_id::VARCHAR, 8) || '...' || chr(10) END) block_sha256
FROM nodes n LEFT JOIN m ON m.doc_id = n.doc_id""",
    "q_request_json": """SELECT conv_id, conv_id::VARCHAR trace_id, 'say "hi"' || chr(10) user_query, count(*)::BIGINT n_nodes, count(*) FILTER (role = 'system')::BIGINT n_uncertain,
sha256(string_agg(coalesce(text, ''), '|' ORDER BY turn)) snippets_sha256 FROM conversations GROUP BY conv_id""",
    "q_chunk_json": "SELECT event_id, user_id::VARCHAR trace_id, event_type || '\"' || chr(92) || chr(10) text_delta, event_id % 2 = 0 done FROM events",
    "q_props_field": "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') k, true flag FROM events",
}
ORACLE_SQL["q_stream_upsert"] = ORACLE_SQL["q_upsert_lww"]
ORACLE_SQL |= paths({"fnv": _FNV, "signed": _SIGNED, "prints": _PRINTS, "match": _MATCH, "nodes": _NODES, "href": _HREF, "buys": _BUYS, "supplied": _SUPPLIED, "trade": _TRADE, "sparse": _SPARSE, "q": _Q, "cos": _COS, "stop": _STOP})
ORACLE_SQL |= code({"sparse": _SPARSE, "prints": _PRINTS, "buys": _BUYS, "renames": _RENAMES, "match": _MATCH, "nodes": _NODES, "stop": _STOP})
