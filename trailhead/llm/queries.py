"""The registered queries of the training-data operators: thin, whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, clustering, decontaminate, mixing, new_sql, quality, repair, runtime, simhash, sketches, substrings, suffix_arrays, token_counts, warc

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(runtime.table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark(docs, runtime.table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def token_digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_digests(bpe.decode(bpe.encode(docs, path), path))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text")
    words = F.trim(F.regexp_replace("kept", r"[\x20\x09-\x0D]+", " "))
    return substrings.dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op10_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_arrays.dedup(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", token_counts.proof_edits())
    counted = token_counts.count(docs, public_tokenizers.path(VOCABULARY), edits_col="edits")
    return counted.select("doc_id", "n_pretokens", "n_tokens", "edited_n_tokens", "n_reencoded", F.sha2("edited_text", 256).alias("edited_sha256"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = runtime.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -1L conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' text FROM VALUES (0L, 'user'), (1L, 'assistant') t(turn, role)")
    filled = told.unionByName(probe).select(F.struct("conv_id", "turn").alias("_at"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = chat.turns(filled, "_at", chat.TURN_ROWS).select("_at.conv_id", "_at.turn", "role", "text")
    back = chat.read_back(chat.render(rows, "conv_id", "turn"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(spark, runtime.table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, runtime.table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def op9_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.neighbours(runtime.table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(runtime.table(spark, sf_dir, "conversations")))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, centroids = clustering.cluster(clustering.quantised(runtime.table(spark, sf_dir, "embeddings")))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return clustering.report(placed, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(runtime.table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op1_simhash": op1_simhash, "op2_decontaminate": op2_decontaminate, "op3_bpe": op3_bpe, "op4_substrings": op4_substrings, "op5_token_counts": op5_token_counts, "op6_chat": op6_chat, "op7_warc": op7_warc, "op8_quality": op8_quality, "op9_sketches": op9_sketches, "op10_suffix_arrays": op10_suffix_arrays, "op11_repair": op11_repair, "op12_clusters": op12_clusters, "op13_mixture": op13_mixture}

#: Every window of every item as a text of words, met by equality; hit words are those that a window covers.
OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
win AS (SELECT item, least(len(w), 10) n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i, w FROM b WHERE len(w) > 0),
keys AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') k FROM win),
lens AS (SELECT DISTINCT n FROM keys),
pos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, lens WHERE len(w) >= n),
hit AS (SELECT DISTINCT doc_id, i, pos.n, item FROM pos JOIN keys ON keys.n = pos.n AND k = array_to_string(w[i : i + pos.n - 1], ' ')),
word AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) i, w FROM d WHERE len(w) >= 20),
seen AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i : i + 19], ' ') ORDER BY doc_id, i) n FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) p FROM seen WHERE n > 1),
word AS (SELECT doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) k, count(*) n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT n_words, (len(w) - coalesce(n, 0))::BIGINT n_removed, sha256(coalesce(k, '')) kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

#: Escapes as in the template: a doubled backslash, then a backslash after the first character of control strings.
_ESCAPED = r"""regexp_replace(regexp_replace(replace({0}, '\', '\\'), '<(/?s>|\|(?:im_start|im_end|im_sep|system|user|assistant|endoftext|begin_of_text|end_of_text|start_header_id|end_header_id|eot_id|end|pad)\|>|</?SYS>>|/?SYS>>|start_of_turn>|end_of_turn>|bos>|eos>|pad>|unk>)', '<\\\1', 'g'), '\[(/?INST\]|/?SYSTEM_PROMPT\])', '[\\\1', 'g')"""
OP6_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') t FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) turns_sha256,
coalesce(sum(len(t)) FILTER (r = 'assistant'), 0)::BIGINT loss_chars,
sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) loss_sha256,
sum(24 + len(replace({_ESCAPED.format("r")}, chr(10), '\\' || chr(10))) + len({_ESCAPED.format("t")}))::BIGINT formatted_chars
FROM c GROUP BY conv_id
"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
f AS (SELECT h, min(page_id) first FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT page_id, strlen(p.h)::BIGINT payload_bytes, sha256(p.h) payload_digest,
CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END record_type, CASE WHEN first <> page_id THEN first END refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""

#: Texts as hexadecimal digits, windows of 200 of them (cut from blocks, so that a cut is short).
OP10_SQL = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) x FROM documents),
blk AS (SELECT doc_id, len(x) // 2 n, c, substr(x, 2 * c + 1, 2 * 611) y FROM (SELECT doc_id, x, unnest(range(0, greatest(len(x) // 2 - 99, 0), 512)) c FROM d)),
win AS (SELECT doc_id, c + j i, md5_number(substr(y, 2 * j + 1, 200)) h FROM (SELECT *, unnest(range(0, least(512, n - 99 - c))) j FROM blk)),
seen AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) n FROM win),
late AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) gap FROM seen WHERE n > 1),
run AS (SELECT doc_id, i, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) g FROM late),
span AS (SELECT doc_id, g, min(i) a, max(i) + 100 b FROM run GROUP BY ALL),
cut AS (SELECT doc_id, count(*) n_spans, sum(b - a) n_removed FROM span GROUP BY doc_id),
part AS (SELECT doc_id, b p, lead(a) OVER (PARTITION BY doc_id ORDER BY a) q FROM span UNION ALL SELECT doc_id, 0, min(a) FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * p + 1, 2 * (coalesce(q, len(x) // 2) - p)), '' ORDER BY p) k FROM part JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT n_bytes, coalesce(n_removed, 0)::BIGINT n_removed, coalesce(n_spans, 0)::BIGINT n_spans, sha256(unhex(coalesce(k, x))) kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = new_sql.ORACLE_SQL | {"op10_suffix_arrays": OP10_SQL, "op2_decontaminate": OP2_SQL, "op4_substrings": OP4_SQL, "op6_chat": OP6_SQL, "op7_warc": OP7_SQL}
