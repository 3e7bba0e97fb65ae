"""DuckDB SQL of the operators 11 to 13, built from their rules: nothing here is shared with the Spark code."""

from __future__ import annotations


def _clusters(rounds: int = 10) -> str:
    """Every round in full: all distances, the nearest, exact floors of means."""
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1)::INTEGER c, x FROM v QUALIFY c < 8)",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"d{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) c, min(d) d FROM (SELECT r, c, list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT d FROM v, c{i} k) GROUP BY r)"
        )
        if i < rounds:
            parts.append(
                f"m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) x FROM (SELECT c, p, sum(e)::BIGINT s, count(*) n FROM (SELECT c, unnest(x) e, unnest(range(64)) p FROM d{i} JOIN v USING (r)) GROUP BY c, p) GROUP BY c)"
            )
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k.c, coalesce(m{i}.x, k.x) x FROM c{i} k LEFT JOIN m{i} USING (c))")
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, d.c AS cluster, d AS distance, sum(d) OVER (PARTITION BY d.c)::BIGINT cluster_inertia, sum(d) OVER ()::BIGINT inertia,"
        f" sha256(array_to_string(k.x, ',')) centroid_sha256 FROM d{rounds} d JOIN v USING (r) JOIN c{rounds} k ON k.c = d.c"
    )


#: Shares level out where the next source would not be full; expected copies are whole numbers of 2**-32.
_MIXTURE = r"""
WITH d AS (SELECT doc_id, source, coalesce('=' || source, '') k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size, text FROM documents),
s AS (SELECT k, sum(size)::BIGINT n, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY k = '', k) - 1) % 3 + 1)::INTEGER]::DOUBLE w FROM d GROUP BY k),
o AS (SELECT *, sum(n) OVER ()::BIGINT - 3 * coalesce(sum(n) OVER q, 0)::BIGINT rest, sum(w) OVER () - coalesce(sum(w) OVER q, 0) open FROM s WINDOW q AS (ORDER BY 3 * n / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(arg_min(rest / open, 3 * n / w) FILTER (3 * n > w * (rest / open)), max(3 * n / w)) level FROM o),
t AS (SELECT k, n, least(w * level, 3 * n::DOUBLE) target FROM s, l),
e AS (SELECT k, n, target, CASE WHEN n > 0 THEN least(round(target / n * 4294967296.0)::BIGINT, 3 * 4294967296) ELSE 0 END e, ('0x' || substr(sha256('13:' || k), 1, 8))::BIGINT o FROM t),
r AS (SELECT doc_id, size, n, target, e, (o + coalesce(sum(e) OVER (PARTITION BY k ORDER BY size, doc_id NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 4294967296 f FROM d JOIN e USING (k))
SELECT doc_id, size, n AS source_size, target, (size * ((f + e) // 4294967296))::BIGINT taken FROM r
"""


def _repair() -> str:
    """Forward over the rows of all conversations at once: for each grammar state the least (cost and letters, repaired rows)
    that leads there.  crc32 is made from its polynomial, since DuckDB has none."""

    def add(x: str, cost: str, letter: str, role: str | None = None, text: str = "''") -> str:
        line = "" if role is None else f" || CASE WHEN {x}.t = '' THEN '' ELSE chr(10) END || {role} || ':' || {text}"
        return f"CASE WHEN {x} IS NOT NULL THEN {{'k': printf('%012d', substr({x}.k, 1, 12)::BIGINT + {cost}) || substr({x}.k, 13) || '{letter}', 't': {x}.t{line}}} END"

    def stay(x: str, letter: str, when: str, role: str) -> str:
        return f"CASE WHEN stays AND {when} THEN {add(x, 'cut::BIGINT' if letter == 'K' else '2 + cut::BIGINT', letter, role, 'text')} END"

    def relaxed(src: str, times: int = 3) -> str:
        """Inserts before the next row."""
        for _ in range(times):
            u = ", ".join(["bu", *(add(x, "2", "I", "'user'") for x in ("b0", "bs", "ba"))])
            src = f"(SELECT * REPLACE (least({u}) AS bu, least(ba, {add('bu', '2', 'I', chr(39) + 'assistant' + chr(39))}) AS ba) FROM {src})"
        return src

    to_u = [y for x in ("b0", "bs", "ba") for y in (stay(x, "K", "i = 'u'", "role"), stay(x, "R", "true", "'user'"))]
    moves = {
        "b0": [], "bs": [stay("b0", "K", "i = 's'", "role")], "bu": to_u,
        "ba": [stay("bu", "K", "i = 'a'", "role"), stay("bu", "R", "true", "'assistant'")],
    }  # fmt: skip
    stepped = ", ".join(f"least({', '.join([add(k, '3', 'D'), *v, 'NULL'])}) AS {k}" for k, v in moves.items())
    return rf"""
WITH RECURSIVE bits AS (SELECT range b, range::BIGINT x, 0 n FROM range(256) UNION ALL SELECT b, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), n + 1 FROM bits WHERE n < 8),
crc AS (SELECT list(x ORDER BY b) t FROM bits WHERE n = 8),
h AS (SELECT conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 20 k
FROM conversations, crc),
e AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END text FROM (SELECT *, unnest(range(CASE k WHEN 3 THEN 2 WHEN 0 THEN 0 ELSE 1 END)) FROM h)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) n, left(role, 1) i FROM e),
f AS (SELECT *, NOT regexp_matches(text, '[^ 	-]') blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 dup, regexp_extract(text, '([^ 	-])[ 	-]*$', 1) NOT IN ('.', '!', '?') cut,
lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i pair FROM o),
r AS (SELECT *, NOT blank AND NOT dup stays FROM f),
w AS (SELECT DISTINCT conv_id, 0::BIGINT n, {{'k': '000000000000', 't': ''}} b0, NULL::STRUCT(k VARCHAR, t VARCHAR) bs, NULL::STRUCT(k VARCHAR, t VARCHAR) bu, NULL::STRUCT(k VARCHAR, t VARCHAR) ba FROM conversations
UNION ALL SELECT conv_id, n, {stepped} FROM (SELECT w.* EXCLUDE (n), r.n, r.role, r.text, r.i, r.stays, r.cut FROM {relaxed("w")} w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1)),
z AS (SELECT conv_id, least(b0, ba) best FROM {relaxed("(SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1)")}),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT gaps, count_if(blank)::BIGINT blank, count_if(dup AND NOT blank)::BIGINT duplicate, count_if(stays AND cut)::BIGINT truncated, count_if(pair NOT IN ('su', 'ua', 'au'))::BIGINT illegal FROM r GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
substr(best.k, 1, 12)::BIGINT AS cost, substr(best.k, 13) audit, sha256(best.t) repaired_sha256
FROM z LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM z.conv_id
"""


ORACLE_SQL = {"op11_repair": _repair(), "op12_clusters": _clusters(), "op13_mixture": _MIXTURE}
