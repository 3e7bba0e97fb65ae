"""DuckDB SQL for ``code_queries``."""

from __future__ import annotations

from .oracle_paths import _FOLLOWING, _SEEDS, FUSED, PICKED, WALKED, _s
from .retrieve import NO_EDGES, NO_MATCH

#: A query's own edges: out of its candidates.
_OWN = (
    PICKED.replace("SELECT DISTINCT id, n FROM (SELECT source_id id, target_id n FROM edges UNION ALL SELECT target_id, source_id FROM edges) WHERE id IN (SELECT id FROM cand)",
                   "SELECT DISTINCT query_id, id, n FROM (SELECT query_id, source_id id, target_id n FROM qe UNION ALL SELECT query_id, target_id, source_id FROM qe) JOIN (SELECT query_id, id FROM cand) USING (query_id, id)")
    .replace("size AS (SELECT id, count(*) c FROM near GROUP BY 1)", "size AS (SELECT query_id, id, count(*) c FROM near GROUP BY ALL)")
    .replace("JOIN near x ON x.id = a JOIN near y ON y.id = b AND y.n = x.n", "JOIN near x ON x.id = a AND x.query_id = pair.query_id JOIN near y ON y.id = b AND y.n = x.n AND y.query_id = x.query_id")
    .replace("SELECT query_id, a, b, count(*) mutual", "SELECT pair.query_id, a, b, count(*) mutual")
    .replace("linked AS (SELECT query_id, a, b FROM pair JOIN near ON id = a AND n = b)", "linked AS (SELECT pair.query_id, a, b FROM pair JOIN near ON id = a AND n = b AND near.query_id = pair.query_id)")
    .replace("JOIN size x ON x.id = pair.a JOIN size y ON y.id = pair.b", "JOIN size x ON x.id = pair.a AND x.query_id = pair.query_id JOIN size y ON y.id = pair.b AND y.query_id = pair.query_id")
)


def code(c: dict[str, str]) -> dict[str, str]:
    """The SQL by query; ``c``: texts of common table expressions."""
    sources = r"""t AS (SELECT doc_id i, doc_id::VARCHAR s, strlen(regexp_replace(coalesce(text, ''), '[\x00-\x1F"\\*]', ' ', 'g')) said, doc_id % 3 = 2 cpp, doc_id % 7 = 3 AND doc_id % 3 <> 2 bad FROM documents),
f AS (SELECT *, 'd' || s || CASE WHEN cpp THEN '.cpp' ELSE '.py' END file_path, CASE WHEN cpp THEN 'int a_' || s || '(int x) { if (x) { return g_' || (i % 7) || '(x); } return h_' || (i % 5) || '(x); }'
  ELSE 'def a_' || s || '(x):' || chr(10) || '    for i in x:' || chr(10) || '        g_' || (i % 7) || '(i)' || chr(10) || '    return h_' || (i % 5) || '(x)' END one,
  'def broken_' || s || '(x:' || chr(10) || '    return lost(x, (' lost FROM t),
p AS (SELECT *, CASE WHEN cpp THEN 13 ELSE 12 END a0, a0 + strlen(one) a1, a1 + 2 b0, CASE WHEN bad THEN b0 + strlen(lost) END b1,
  CASE WHEN cpp THEN a1 + 1 ELSE coalesce(b1, a1) + 2 + 13 END m0,
  m0 + CASE WHEN cpp THEN strlen('void K::m_' || s || '() { /* ') + said + strlen(' */ a_' || s || '(1); }') ELSE strlen('def m_' || s || '(self):') + 12 + said + strlen('\"\"\"' || '         return self.p(a_' || s || '(1))') END m1 FROM f),
spans AS (SELECT file_path, 0 pos, a0 byte_start, a1 byte_end, 'a_' || s AS name, 1.0::DOUBLE confidence, false broken, ['g_' || (i % 7), 'h_' || (i % 5)] calls, i FROM p
UNION ALL SELECT file_path, 1, b0, b1, 'broken_' || s, 0.25, true, ['lost'], i FROM p WHERE bad
UNION ALL SELECT file_path, CASE WHEN bad THEN 2 ELSE 1 END, m0, m1, 'm_' || s, 1.0, false, CASE WHEN cpp THEN ['a_' || s] ELSE ['self', 'a_' || s] END, i FROM p)"""
    sources = sources.replace(r"\"", '"')
    asked = f"""WITH RECURSIVE {c['match']}, {c['nodes']}, {_FOLLOWING.replace('edges AS (', 'every_edge AS (')}, edges AS (SELECT * FROM every_edge WHERE source_id::BIGINT % 9 <> 4),
sparse AS (SELECT doc_id, (h % 384)::INT bucket, sum(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN -1 ELSE 1 END)::BIGINT v FROM tok JOIN hashed USING (t) WHERE t NOT IN ({c['stop']}) GROUP BY ALL HAVING v <> 0),
norm AS (SELECT doc_id, sqrt(sum(v * v)::DOUBLE) n FROM sparse GROUP BY 1), ask AS (SELECT doc_id FROM documents WHERE doc_id % 50 = 0),
dots AS (SELECT q.doc_id q, d.doc_id, sum(q.v * d.v)::DOUBLE x FROM sparse q JOIN sparse d USING (bucket) WHERE q.doc_id IN (FROM ask) GROUP BY ALL),
scored AS (SELECT ask.doc_id query_id, d.doc_id::VARCHAR id, coalesce(round(x / (nq.n * nd.n), 12), 0) score FROM ask JOIN documents d ON true LEFT JOIN dots ON (dots.q, dots.doc_id) = (ask.doc_id, d.doc_id) LEFT JOIN norm nq ON nq.doc_id = ask.doc_id LEFT JOIN norm nd ON nd.doc_id = d.doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) r FROM scored QUALIFY r <= 5),
first AS (SELECT query_id, id seed FROM best WHERE r = 1 AND score >= 0.05), seeds AS (SELECT DISTINCT seed FROM first), {FUSED},
live AS (SELECT * FROM nodes WHERE doc_id % 9 <> 4),
cand AS (SELECT first.query_id, f.id, coalesce(b.score, 0.5) relevance, rank FROM first JOIN fused f USING (seed) JOIN live ON live.id = f.id LEFT JOIN best b ON b.query_id = first.query_id AND b.id = f.id)"""
    walked = WALKED.replace("(VALUES (0, 0.5::DOUBLE, 1e-4::DOUBLE), (1, 0.1::DOUBLE, 1e-5::DOUBLE))", "(VALUES (0, 0.3::DOUBLE, 1e-5::DOUBLE))").replace("39 - touched", "3 - touched").replace("touched < 40", "touched < 4").replace("touched >= 40", "touched >= 4")
    near = asked.partition("first AS (")[0].rstrip().rstrip(",")
    return {
        "q_topk_pruned": f"{near} SELECT query_id, d.doc_id id, round(score, 9) score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d.doc_id)::INT rank FROM scored JOIN documents d ON d.doc_id::VARCHAR = scored.id QUALIFY rank <= 5",
        "q_questions": f"""{asked}, qe AS (SELECT query_id, source_id, target_id FROM cand JOIN edges ON source_id = cand.id), {_OWN}
SELECT query_id, pick - 1 pos, n.id node_id, sha256(coalesce(text, '')) snippet_sha256, conf < 0.5 uncertain FROM picked JOIN live n ON n.id = picked.id""",
        "q_refusals": f"""{asked} SELECT ask.doc_id query_id, CASE WHEN seed IS NULL THEN {_s(NO_MATCH)} ELSE {_s(NO_EDGES)} END reason FROM ask LEFT JOIN first ON query_id = ask.doc_id
WHERE ask.doc_id NOT IN (SELECT query_id FROM cand)""",
        "q_embed_dense": f"""WITH {c['sparse']}, n AS (SELECT doc_id, sqrt(sum(v * v)::DOUBLE) n FROM sparse GROUP BY 1)
SELECT doc_id, 384::BIGINT dim, bucket, round((v / n)::FLOAT::DOUBLE, 5) x FROM sparse JOIN n USING (doc_id)""",
        "q_trace_times": """SELECT 't' || p trace_id, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (doc_id % 50 = 0 AND doc_id % 2 = p), '') node_ids, true AS "now" FROM documents, range(2) r(p) GROUP BY p""",
        "q_chunk_stream": """SELECT user_id::VARCHAR trace_id, sha256(string_agg(event_type || '"' || chr(92) || chr(10), '' ORDER BY event_id)) text_sha256, count(*)::BIGINT pieces, bool_or(event_id % 50 = 0) unverified FROM events GROUP BY user_id""",
        "q_hub_walks": f"""WITH RECURSIVE c AS (SELECT 'c:' || c_custkey c, 'n:' || c_nationkey n, (c_custkey % 97 + 1)::DOUBLE w FROM customer),
edges AS (SELECT c source_id, n target_id, 'IN' "type", 1::DOUBLE weight FROM c UNION ALL SELECT n, c, 'IN', w FROM c), {_SEEDS}, {walked} SELECT seed, id, round(score, 9) score FROM walk""",
        "q_stream_match": f"""WITH {c['prints']}, e AS (SELECT doc_id * 2 seq, source path, 'U' op, simhash FROM prints UNION ALL SELECT doc_id * 2 + 41, source, 'D', simhash FROM prints WHERE doc_id % 5 = 0),
n AS (SELECT *, left(sha256(path || chr(31) || simhash), 32) id FROM e),
held AS (SELECT a.seq, a.path, a.id, b.path other, b.id other_id, arg_max(b.op, (b.seq, b.op)) last FROM n a JOIN n b ON a.simhash = b.simhash AND b.seq < a.seq WHERE a.op = 'U' GROUP BY ALL HAVING last = 'U'),
met AS (SELECT seq, path, bool_or(other = path) known, min(other_id) FILTER (other <> path) there FROM held GROUP BY ALL)
SELECT n.seq, n.id, NOT coalesce(known, false) is_new, CASE WHEN NOT coalesce(known, false) THEN there END renamed_from FROM n LEFT JOIN met ON met.seq = n.seq AND met.path = n.path WHERE n.op = 'U'""",
        "q_upsert_delta": f"""WITH {c['buys']}, k AS (SELECT *, substr(target_id, 3)::BIGINT p FROM buys)
SELECT source_id, target_id, CASE WHEN p % 200 = 7 THEN 0.5 ELSE weight + CASE WHEN p % 100 = 7 THEN 10 ELSE 0 END END weight FROM k WHERE p % 50 <> 7 OR p % 200 = 7""",
        "q_tombstone_layers": f"WITH {c['buys']} SELECT source_id, target_id, weight, true base_kept FROM buys WHERE substr(target_id, 3)::BIGINT % 1000 >= 2 AND substr(source_id, 3)::BIGINT % 1000 <> 1",
        "q_migration": """WITH e AS (SELECT doc_id, 'd' || doc_id AS path, CASE doc_id % 3 WHEN 0 THEN 'SyntaxError' WHEN 1 THEN 'ValueError' END kind, concat_ws(': ', CASE doc_id % 3 WHEN 0 THEN 'SyntaxError' WHEN 1 THEN 'ValueError' END, coalesce(lang, '')) AS message FROM documents)
SELECT 1 step, path, message, kind FROM e WHERE doc_id % 2 = 0
UNION ALL SELECT 2, path, CASE WHEN doc_id % 5 = 0 THEN 'again' ELSE message END, CASE WHEN doc_id % 5 = 0 THEN 'Given' ELSE kind END FROM e WHERE doc_id % 2 = 0 OR doc_id % 5 = 0""",
        "q_alias_increment": f"WITH RECURSIVE {c['renames']} SELECT o old_id, n new_id, r root_id, c commit_hash FROM folded",
        "q_spans": f"WITH {sources} SELECT file_path, pos, byte_start::BIGINT byte_start, byte_end::BIGINT byte_end, name, confidence, broken FROM spans",
        "q_calls": f"WITH {sources} SELECT file_path, name, unnest(range(len(calls)))::INT n, unnest(calls) callee FROM spans",
        "q_code_edges": f"""WITH {sources}, live AS (SELECT * FROM spans WHERE i % 2 = 0 OR (i % 4 <> 2 AND i % 10 <> 1))
SELECT DISTINCT file_path, 'CALLS' "type", 'sym:' || unnest(calls) target_id FROM live UNION ALL SELECT file_path, 'IMPLEMENTS', 'sym:' || name FROM live""",
        "q_code_counters": f"""WITH {sources} SELECT count(DISTINCT file_path)::BIGINT files_processed, 0::BIGINT paths_tombstoned, count(*)::BIGINT nodes_upserted, 0::BIGINT nodes_skipped,
count(*) FILTER (broken)::BIGINT parse_failures, 0::BIGINT nodes_tombstoned FROM spans""",
    }
