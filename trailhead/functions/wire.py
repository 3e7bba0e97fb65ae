"""Records as JSON, one object a line, and the markers inside answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema


def escape(s: Column) -> Column:
    """Escapes of a JSON string: quote, backslash and newline."""
    return F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def string_field(json: Column, key: str) -> Column:
    """A top-level string; missing: empty."""
    return F.coalesce(F.get_json_object(json, f"$.{key}"), F.lit(""))


def bool_field(json: Column, key: str, default: bool) -> Column:
    return F.coalesce(F.get_json_object(json, f"$.{key}") == "true", F.lit(default))


def encode_request(request: Column) -> Column:
    """struct(traceId, userQuery, requireCitations, context) as JSON, keys in that order."""
    return F.to_json(request, {"ignoreNullFields": "false"})


def decode_request(json: Column) -> Column:
    """Missing strings are empty, a missing flag asks for citations, and the context ends before a node without id."""
    r = F.from_json(json, schema.REQUEST)
    nodes = F.coalesce(r["context"], F.array().cast(schema.CONTEXT))
    whole = F.transform(
        nodes,
        lambda c: F.struct(*(F.coalesce(c[k], F.lit("")).alias(k) for k in ("nodeId", "filePath", "codeSnippet")), F.coalesce(c["uncertain"], F.lit(False)).alias("uncertain")),
    )
    stop = F.array_position(F.transform(whole, lambda c: c["nodeId"]), "")
    kept = F.when(stop > 0, F.slice(whole, F.lit(1), (stop - 1).cast("int"))).otherwise(whole)
    return F.struct(
        F.coalesce(r["traceId"], F.lit("")).alias("traceId"), F.coalesce(r["userQuery"], F.lit("")).alias("userQuery"),
        F.coalesce(r["requireCitations"], F.lit(True)).alias("requireCitations"), kept.alias("context"),
    )


def encode_chunk(chunk: Column) -> Column:
    return F.to_json(chunk, {"ignoreNullFields": "false"})


def decode_chunk(json: Column) -> Column:
    r = F.from_json(json, schema.CHUNK)
    text = [F.coalesce(r[k], F.lit("")).alias(k) for k in ("traceId", "textDelta")]
    return F.struct(*text, *(F.coalesce(r[k], F.lit(False)).alias(k) for k in ("done", "unverifiedCitation")))


def model_answer(json: Column) -> Column:
    """The first message content in a chat model's reply; missing: empty."""
    found = F.coalesce(F.get_json_object(json, "$.message.content"), F.get_json_object(json, "$.choices[0].message.content"), F.get_json_object(json, "$.content"))
    return F.coalesce(found, F.lit(""))


def citations(text: Column) -> Column:
    """Distinct ids cited as ``[node:<id>]``, in order of first use; an unfinished marker ends the scan."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[node:([^\]]*)\]"), F.lit(1)))


def id_array(json: Column) -> Column:
    """A JSON array of ids."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def byte_slice(data: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a binary, clamped to it; empty where nothing is left."""
    a = F.greatest(start, F.lit(0).cast("long"))
    b = F.least(end, F.octet_length(data).cast("long"))
    return F.when(b > a, F.substring(data, (a + 1).cast("int"), (b - a).cast("int"))).otherwise(F.lit(b""))


def short_id(c: Column) -> Column:
    return F.substring(c, 1, 8)


#: How a rendered trace names a node's confidence.
HIGH, LOW = "HIGH (Structured AST Node)", "LOW (Whole-File Degrade)"


def confidence_label(c: Column) -> Column:
    return F.when(c >= schema.LOW_CONFIDENCE, HIGH).otherwise(LOW)


def uncertain(c: Column) -> Column:
    return c < schema.LOW_CONFIDENCE
