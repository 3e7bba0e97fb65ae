"""DuckDB SQL for walks, stored tables, ingestion and the question path.

A walk, a greedy choice and a fold of renames are recursive queries whose state is one row of lists.
"""

from __future__ import annotations

from ..functions.wire import HIGH, LOW
from ..sources.git import MESSAGE
from .retrieve import LINKS, NO_MATCH, UNCERTAIN, UNVERIFIED
from .retrieve_text import CITED, RULE, THIN, UNCITED


def _s(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


#: From ``edges`` (source_id, target_id, type, weight) and ``seeds`` (seed): (h, seed, id, score) of walks from each seed.
WALKED = """
deg AS (SELECT source_id u, count(*)::INT d FROM edges GROUP BY 1),
adj AS (SELECT source_id u, list({'t': target_id, 'w': weight, 'd': greatest(coalesce(d, 0), 1)} ORDER BY target_id, "type") o, sum(weight) total
  FROM edges LEFT JOIN deg ON deg.u = target_id GROUP BY 1),
horizons(h, alpha, eps) AS (VALUES (0, 0.5::DOUBLE, 1e-4::DOUBLE), (1, 0.1::DOUBLE, 1e-5::DOUBLE)),
w AS (SELECT h, seed, alpha, eps, [seed] queue, [{'i': seed, 'm': 1::DOUBLE}] r, []::STRUCT(i VARCHAR, m DOUBLE)[] p, 0 touched FROM seeds, horizons
UNION ALL
SELECT h, seed, alpha, eps,
  CASE WHEN skip THEN rest ELSE rest || list_transform(cand[: greatest(39 - touched - len(rest), 0)], lambda x: x.t) END,
  CASE WHEN skip THEN r ELSE r0 || list_transform(o, lambda x: {'i': x.t, 'm': (1 - alpha) * mass * x.w / total}) END,
  CASE WHEN skip THEN p ELSE list_append(p, {'i': u, 'm': alpha * mass}) END,
  CASE WHEN skip THEN touched ELSE touched + 1 END
FROM (SELECT *, list_filter(o, lambda x: (coalesce(list_sum(list_transform(list_filter(r0, lambda y: y.i = x.t), lambda y: y.m)), 0) + (1 - alpha) * mass * x.w / total) / x.d >= eps AND NOT list_contains(rest, x.t)) cand,
    mass <= 0 OR (len(o) = 0 AND mass < eps) skip
  FROM (SELECT h, seed, alpha, eps, w.r, p, touched, queue[1] u, queue[2:] rest, list_filter(w.r, lambda y: y.i <> queue[1]) r0,
      coalesce(list_sum(list_transform(list_filter(w.r, lambda y: y.i = queue[1]), lambda y: y.m)), 0) mass,
      coalesce(adj.o, []) o, CASE WHEN total > 0 THEN total ELSE 1 END total
    FROM w LEFT JOIN adj ON adj.u = queue[1] WHERE len(queue) > 0 AND touched < 40))),
walk AS (SELECT h, seed, i id, list_sum(list_transform(list_filter(p, lambda y: y.i = i), lambda y: y.m)) score
  FROM (SELECT h, seed, p, unnest(list_distinct(list_transform(p, lambda y: y.i))) i FROM w WHERE len(queue) = 0 OR touched >= 40))"""
#: The walks of a seed fused: (seed, id, score, rank).
FUSED = f"""{WALKED},
place AS (SELECT seed, id, row_number() OVER (PARTITION BY h, seed ORDER BY score DESC, id) n FROM walk),
every AS (SELECT seed, id, sum(1::DOUBLE / (60 + n)) score FROM place GROUP BY ALL),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, id)::INT rank FROM every) WHERE rank <= 40)"""
#: From ``cand`` (query_id, id, relevance, rank) and ``edges``: (query_id, a, b, redundancy) of pairs that have any.
PAIRS = """
near AS (SELECT DISTINCT id, n FROM (SELECT source_id id, target_id n FROM edges UNION ALL SELECT target_id, source_id FROM edges) WHERE id IN (SELECT id FROM cand)),
size AS (SELECT id, count(*) c FROM near GROUP BY 1),
pair AS (SELECT a.query_id, a.id a, b.id b FROM cand a JOIN cand b ON a.query_id = b.query_id AND a.id <> b.id),
shared AS (SELECT query_id, a, b, count(*) mutual FROM pair JOIN near x ON x.id = a JOIN near y ON y.id = b AND y.n = x.n GROUP BY ALL),
linked AS (SELECT query_id, a, b FROM pair JOIN near ON id = a AND n = b),
red AS (SELECT pair.query_id, pair.a, pair.b, CASE WHEN l.a IS NOT NULL THEN 1 ELSE mutual::DOUBLE / (x.c + y.c - mutual) END redundancy
  FROM pair LEFT JOIN shared s ON (s.query_id, s.a, s.b) = (pair.query_id, pair.a, pair.b) LEFT JOIN linked l ON (l.query_id, l.a, l.b) = (pair.query_id, pair.a, pair.b)
  JOIN size x ON x.id = pair.a JOIN size y ON y.id = pair.b WHERE mutual > 0 OR l.a IS NOT NULL)"""
#: The ten that a greedy choice takes of them: (query_id, id, score, pick).
PICKED = f"""{PAIRS},
given AS (SELECT cand.query_id, list({{'id': cand.id, 'rel': relevance, 'red': coalesce(m, MAP {{}})}} ORDER BY rank, cand.id) c
  FROM cand LEFT JOIN (SELECT query_id, a, map(list(b), list(redundancy)) m FROM red GROUP BY ALL) x ON (x.query_id, x.a) = (cand.query_id, cand.id) GROUP BY 1),
pick AS (SELECT query_id, c, []::STRUCT(id VARCHAR, score DOUBLE)[] chosen FROM given
UNION ALL
SELECT query_id, list_filter(c, lambda x: x.id <> best.id), list_append(chosen, best)
FROM (SELECT query_id, c, chosen, list_filter(s, lambda x: x.score = list_max(list_transform(s, lambda y: y.score)))[1] best
  FROM (SELECT query_id, c, chosen, list_transform(c, lambda x: {{'id': x.id, 'score': 0.7::DOUBLE * x.rel - (1 - 0.7::DOUBLE) * coalesce(list_max(list_transform(chosen, lambda y: coalesce(x.red[y.id], 0))), 0)}}) s
    FROM pick WHERE len(c) > 0 AND len(chosen) < 10))),
picked AS (SELECT query_id, unnest(range(1, len(chosen) + 1))::INT pick, unnest(chosen, recursive := true) FROM pick WHERE len(c) = 0 OR len(chosen) = 10)"""
_BALANCES = "cand AS (SELECT (q * 1000000 + n // 40)::BIGINT query_id, id, relevance, (n % 40 + 1)::INT rank FROM (SELECT s_nationkey q, 's:' || s_suppkey id, s_acctbal / 10000 relevance, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1 n FROM supplier))"
_SEEDS = "seeds AS (SELECT 'c:' || c_custkey seed FROM customer WHERE c_custkey % 50 = 0)"
_RENAMES = """ev AS (SELECT user_id, event_id, user_id || '/' || event_type o, user_id || '/' || lead(event_type) OVER u n FROM events WINDOW u AS (PARTITION BY user_id ORDER BY event_id)),
step AS (SELECT user_id, list({'o': o, 'n': n, 'c': event_id::VARCHAR} ORDER BY event_id) e FROM ev WHERE o <> n GROUP BY 1),
fold AS (SELECT user_id, e, []::STRUCT(o VARCHAR, n VARCHAR, r VARCHAR, c VARCHAR)[] t FROM step
UNION ALL
SELECT user_id, e[2:], list_transform(list_append(list_filter(t, lambda x: x.o <> e[1].o), {'o': e[1].o, 'n': e[1].n, 'r': root, 'c': e[1].c}), lambda x: {'o': x.o, 'n': x.n, 'r': CASE WHEN x.r = e[1].o THEN root ELSE x.r END, 'c': x.c})
FROM (SELECT *, coalesce(list_filter(t, lambda x: x.o = e[1].n)[1].r, e[1].n) root FROM fold WHERE len(e) > 0)),
folded AS (SELECT user_id, unnest(t, recursive := true) FROM fold WHERE len(e) = 0)"""
_FOLLOWING = """edges AS (SELECT DISTINCT a.doc_id::VARCHAR source_id, b.doc_id::VARCHAR target_id, 'NEXT' "type", 1::DOUBLE weight FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1
UNION ALL SELECT doc_id::VARCHAR, match_id::VARCHAR, 'SAME', 2 FROM matched WHERE doc_id <> match_id)"""
_TRADERS = """tn AS (SELECT 'c:' || c_custkey id, c_mktsegment file_path, strlen(c_name)::BIGINT byte_end, c_acctbal > 0 sure FROM customer
UNION ALL SELECT 'p:' || p_partkey, p_brand, strlen(p_name), p_size >= 25 FROM part UNION ALL SELECT 's:' || s_suppkey, 'supplier', strlen(s_name), s_acctbal > 0 FROM supplier)"""
#: Pages in two batches: with even ids, then all; what the second finds and leaves.
_BATCHES = """one AS (SELECT url, arg_max(html, page_id) h FROM pages WHERE url IS NOT NULL AND page_id % 2 = 0 GROUP BY 1),
two AS (SELECT url, arg_max(html, page_id) h, max(page_id) last FROM pages WHERE url IS NOT NULL GROUP BY 1),
held AS (SELECT two.url, coalesce(one.h, '') <> '' known, coalesce(two.h, '') <> '' AND last % 11 <> 0 live, CASE WHEN coalesce(one.h, '') <> '' THEN one.h ELSE two.h END html FROM two LEFT JOIN one USING (url))"""


def paths(c: dict[str, str]) -> dict[str, str]:
    """The SQL by query; ``c``: texts of common table expressions."""
    trade = f"{c['trade']}, edges AS (SELECT *, 'CALLS' \"type\" FROM trade), {_SEEDS}"
    supplied = f"{c['supplied']}, edges AS (FROM supplied), {_BALANCES}"
    ingested = f"{_BATCHES}, h AS (SELECT *, {c['signed'].format(c['fnv'].format('url'))} simhash FROM held WHERE known OR live)"
    shown = f"""'{RULE}' || chr(10) || 'FILE: doc/' || n.id || '  [' || left(n.id, 8) || '...]' || chr(10) || 'CONFIDENCE: ' || CASE WHEN conf >= 0.5 THEN '{HIGH}' ELSE '{LOW}' END
|| chr(10) || '{THIN}' || chr(10) || coalesce(text, '') || CASE WHEN coalesce(text, '') <> '' AND right(text, 1) <> chr(10) THEN chr(10) ELSE '' END || '{RULE}' || chr(10) || coalesce({_s(LINKS)} || links, '')"""
    links = "links AS (SELECT source_id, string_agg('  -> ' || \"type\" || ' ' || left(target_id, 8) || '...' || chr(10), '' ORDER BY target_id, \"type\") links FROM edges GROUP BY 1)"
    question = f"""WITH RECURSIVE {c['match']}, {c['nodes']}, {_FOLLOWING},
sparse AS (SELECT doc_id, (h % 384)::INT bucket, sum(CASE WHEN h >= 9223372036854775808::UHUGEINT THEN -1 ELSE 1 END)::BIGINT v FROM tok JOIN hashed USING (t) WHERE t NOT IN ({c['stop']}) GROUP BY ALL HAVING v <> 0),
{c['q']}, length AS (SELECT sqrt(sum(w * w)::DOUBLE) n2 FROM q),
s AS (SELECT doc_id, sqrt(sum(v * v)::DOUBLE) n1, sum(v * coalesce(w, 0))::DOUBLE d FROM sparse LEFT JOIN q USING (bucket) GROUP BY doc_id),
best AS (SELECT doc_id::VARCHAR id, {c['cos']} score FROM s, length ORDER BY score DESC, id LIMIT 5),
seeds AS (SELECT id seed FROM best ORDER BY score DESC, id LIMIT 1), {FUSED}"""
    return {
        "q_local_push": f"WITH RECURSIVE {trade}, {WALKED} SELECT seed, id, round(score, 9) score FROM walk WHERE h = 1",
        "q_dual_horizon": f"WITH RECURSIVE {trade}, {FUSED} SELECT seed, id, round(score, 9) score, rank FROM fused",
        "q_hydrate": f"WITH RECURSIVE {trade}, {FUSED}, {_TRADERS} SELECT seed, id, rank, file_path, byte_end, NOT sure uncertain, coalesce(d, 0)::BIGINT n_edges FROM fused JOIN tn USING (id) LEFT JOIN deg ON u = id",
        "q_push_rounds": f"""WITH {trade}, t AS (SELECT source_id, sum(weight) total FROM trade GROUP BY 1), share AS (SELECT source_id, target_id, weight / total share FROM trade JOIN t USING (source_id)),
r0 AS (SELECT seed, seed id, 1.0::DOUBLE r FROM seeds), r1 AS (SELECT seed, target_id id, sum(0.9 * r * share) r FROM r0 JOIN share ON id = source_id GROUP BY ALL),
r2 AS (SELECT seed, target_id id, sum(0.9 * r * share) r FROM r1 JOIN share ON id = source_id GROUP BY ALL)
SELECT seed, id, round(sum(0.1 * r), 9) score FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY ALL""",
        "q_pair_redundancy": f"WITH {supplied}, {PAIRS} SELECT query_id, a, b, round(redundancy, 9) redundancy FROM red WHERE a < b",
        "q_mmr": f"WITH RECURSIVE {supplied}, {PICKED} SELECT query_id, id, round(score, 9) score, pick FROM picked",
        "q_alias_fold": f"WITH RECURSIVE {_RENAMES} SELECT user_id component, o old_id, n new_id, r root_id, c commit_hash FROM folded",
        "q_alias_record": f"WITH RECURSIVE {_RENAMES} SELECT o old_id, n new_id, r root_id, c commit_hash FROM folded",
        "q_alias_resolve": "SELECT DISTINCT conv_id || '/' || turn id, conv_id || '/' || max(turn) OVER (PARTITION BY conv_id) root FROM conversations",
        "q_simhash_match": f"""WITH {c['prints']} SELECT doc_id::VARCHAR id, min(doc_id::VARCHAR) OVER (PARTITION BY simhash) match_id, min(doc_id::VARCHAR) OVER (PARTITION BY simhash, source) same_file_id FROM prints""",
        "q_upsert_edges": f"""WITH {c['buys']}, {c['supplied']}, k AS (SELECT 'p:' || p_partkey id FROM part WHERE p_size < 40), s AS (SELECT 's:' || s_suppkey id FROM supplier WHERE s_acctbal > 0)
SELECT source_id, target_id, weight + CASE WHEN substr(target_id, 3)::BIGINT % 7 = 0 AND target_id IN (FROM k) THEN 1 ELSE 0 END weight FROM buys
UNION ALL SELECT * FROM supplied WHERE source_id IN (FROM k) AND target_id IN (FROM s)""",
        "q_vectors": "SELECT vec_id::VARCHAR id, round((CASE WHEN vec_id % 3 = 0 THEN embedding[-1] ELSE embedding[1] END)::DOUBLE, 6) head, len(embedding)::BIGINT n FROM embeddings WHERE vec_id % 5 <> 0",
        "q_get_nodes": f"WITH {c['prints']}, {c['nodes']} SELECT id, file_path, byte_end FROM nodes",
        "q_active_ids": "SELECT doc_id::VARCHAR id FROM documents WHERE doc_id % 3 <> 0 AND source = (SELECT min(source) FROM documents)",
        "q_history": """SELECT o_custkey::VARCHAR node_id, o_orderkey::VARCHAR commit_hash, floor(epoch_us(o_orderdate) / 1000000)::BIGINT "timestamp",
CASE WHEN o_orderkey % 3 = 0 THEN 'older' WHEN o_orderstatus = 'F' THEN NULL ELSE nullif(o_orderpriority, '') END synthetic_msg FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0""",
        "q_history_of_commits": f"SELECT DISTINCT l_partkey::VARCHAR node_id, o_orderkey::VARCHAR commit_hash, 7::BIGINT \"timestamp\", {_s(MESSAGE)} synthetic_msg, o_orderpriority message FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
        "q_annotations": f"SELECT l_orderkey::VARCHAR commit_hash, min('part:' || l_partkey) path, {_s(MESSAGE + ' in ')} || min('part:' || l_partkey) \"text\" FROM lineitem GROUP BY l_orderkey",
        "q_trace": f"""WITH {c['match']}, {c['nodes']}, {_FOLLOWING}, {links}, top AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) r FROM documents)
SELECT 't' || ((r - 1) // 40) trace_id, sha256(CASE WHEN bool_or(conf < 0.5) THEN {_s(UNCERTAIN)} || chr(10) || chr(10) ELSE '' END || string_agg(chr(10) || {shown}, '' ORDER BY r)) text_sha256, string_agg(n.id, ',' ORDER BY r) node_ids, 7::BIGINT created_at
FROM top JOIN nodes n USING (doc_id) LEFT JOIN links ON source_id = n.id GROUP BY 1""",
        "q_is_source": r"SELECT page_id, coalesce(regexp_matches(url || ['.py', '.txt', '.hpp', '.cppx'][page_id % 4 + 1], '\.(cpp|h|hpp|cc|py)$'), false) is_source FROM pages",
        "q_live_snippet": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE substr(coalesce(text, ''), 8, 24) END snippet FROM documents",
        "q_symbol_link": f"""WITH {c['href']} SELECT 'n' || page_id source_id, 'sym:' || h target_id, 'CALLS' "type", 1::DOUBLE weight FROM href WHERE h <> '' AND page_id % 4 <> 0
UNION ALL SELECT 'n' || page_id, 'sym:f' || (page_id % 3), 'IMPLEMENTS', 1 FROM pages WHERE page_id % 5 = 0""",
        "q_symbol_stubs": f"""WITH {c['href']}, m AS (SELECT 'sym:' || h id, page_id FROM href WHERE h <> '' AND page_id % 4 <> 0 UNION ALL SELECT 'sym:f' || (page_id % 3), page_id FROM pages WHERE page_id % 5 = 0)
SELECT id, arg_min(url, page_id) file_path, 0::BIGINT byte_start, 1::BIGINT byte_end, false is_active FROM m JOIN pages USING (page_id) GROUP BY id""",
        "q_symbol_renames": """SELECT page_id seq, 0 step, 'n' || (page_id - 1) old_id, 'n' || page_id new_id, 'c' commit_hash FROM pages WHERE page_id % 6 = 1
UNION ALL SELECT page_id, 1, 'sym:f' || (page_id % 3), 'n' || page_id, 'c' FROM pages WHERE page_id % 5 = 0""",
        "q_ingest": f"WITH {ingested} SELECT left(sha256(url || chr(31) || simhash), 32) id, url file_path, 0::BIGINT byte_start, strlen(html)::BIGINT byte_end, simhash, live is_active, 0.0::DOUBLE parse_confidence FROM h",
        "q_stream_ingest": f"WITH {ingested} SELECT left(sha256(url || chr(31) || simhash), 32) id, url file_path, 0::BIGINT byte_start, strlen(html)::BIGINT byte_end, simhash, live is_active FROM h",
        "q_stats": f"""WITH {_BATCHES} SELECT count(*)::BIGINT files_processed, count(*) FILTER (NOT live)::BIGINT paths_tombstoned, count(*) FILTER (live AND NOT known)::BIGINT nodes_upserted,
count(*) FILTER (live AND known)::BIGINT nodes_skipped, 0::BIGINT parse_failures, count(*) FILTER (known AND NOT live)::BIGINT nodes_tombstoned FROM held""",
        "q_match": f"""WITH {c['prints']}, m AS (SELECT doc_id, source, simhash, min(doc_id::VARCHAR) FILTER (doc_id % 2 = 0) OVER (PARTITION BY simhash, source) here, min(doc_id::VARCHAR) FILTER (doc_id % 2 = 0) OVER (PARTITION BY simhash) there,
row_number() OVER (PARTITION BY simhash, source ORDER BY doc_id) n FROM prints),
i AS (SELECT *, coalesce(here, left(sha256(source || chr(31) || simhash), 32)) id FROM m), l AS (SELECT simhash, arg_min(id, doc_id) lead FROM i GROUP BY 1)
SELECT doc_id seq, id, here IS NULL AND n = 1 is_new, CASE WHEN here IS NULL AND n = 1 AND coalesce(there, lead) <> id THEN coalesce(there, lead) END renamed_from FROM i JOIN l USING (simhash)""",
        "q_parse_errors": "SELECT 'p' || page_id || '.py' path, true said FROM pages WHERE html <> ''",
        "q_question": f"""{question}, cand AS (SELECT 0 query_id, f.id, coalesce(b.score, 0.5) relevance, rank FROM fused f JOIN nodes USING (id) LEFT JOIN best b ON b.id = f.id),
all_edges AS (FROM edges), {PICKED.replace('FROM edges', 'FROM (SELECT * FROM all_edges WHERE source_id IN (SELECT id FROM cand))')}
SELECT pick - 1 pos, n.id node_id, 'doc/' || n.id file_path, sha256(coalesce(text, '')) snippet_sha256, conf < 0.5 uncertain FROM picked JOIN nodes n ON n.id = picked.id""",
        "q_question_trace": f"{question} SELECT string_agg(id, ',' ORDER BY rank) node_ids, 1::BIGINT created_at FROM fused JOIN nodes USING (id)",
        "q_answers": f"""WITH f AS (SELECT min(doc_id::VARCHAR) id FROM documents)
SELECT 'cited' "case", true ok, '' reason, true verified, replace({_s(CITED)}, '{{}}', id) "text" FROM f UNION ALL SELECT 'wrong', true, '', false, {_s(UNCITED)} || chr(10) || {_s(UNVERIFIED)}
UNION ALL SELECT 'silent', true, '', NULL, NULL UNION ALL SELECT 'none', false, {_s(NO_MATCH)}, NULL, NULL""",
        "q_any_low": "SELECT source file_path, bool_or(coalesce(quality, 0) < 0.5) any_low_confidence FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source",
        "q_escape": r"""SELECT conv_id, turn, sha256(replace(replace(replace('a\b "' || coalesce(text, '') || '"' || chr(10), '\', '\\'), '"', '\"'), chr(10), '\n')) escaped_sha256 FROM conversations""",
        "q_model_answer": "SELECT conv_id, turn, sha256(CASE WHEN turn % 4 = 3 THEN '' ELSE coalesce(text, '') END) answer_sha256 FROM conversations",
        "q_weighted_simhash": f"""WITH e AS (SELECT user_id, event_type, count(*) c, ({c['fnv'].format('event_type')})::UBIGINT h FROM events GROUP BY ALL),
v AS (SELECT user_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN c ELSE -c END) s FROM e, range(64) r(b) GROUP BY ALL)
SELECT user_id, coalesce(bit_or(1::UBIGINT << b::INT) FILTER (s > 0), 0)::UBIGINT::BIT::BIGINT simhash FROM v GROUP BY 1""",
        "q_request": """SELECT conv_id, 'why' "user", sha256(arg_max(role || ' [node:' || turn || ']' || chr(10) || CASE WHEN role = 'system' THEN '(uncertain)' || chr(10) ELSE '' END || coalesce(text, '') || chr(10) || chr(10), turn)) last_sha256,
count(DISTINCT turn)::BIGINT n_ids FROM conversations GROUP BY conv_id""",
    }
