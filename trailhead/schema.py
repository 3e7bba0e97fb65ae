"""Schemas of the stored tables and of the records that pass between operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Version of the stored tables; ``STEPS`` leads from each to the next and back.
VERSION = 2
DIM = 384
LOW_CONFIDENCE = 0.5


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


NODES = _table(
    ("id", T.StringType(), False), ("file_path", T.StringType(), False), ("byte_start", T.LongType(), False), ("byte_end", T.LongType(), False),
    ("simhash", T.LongType(), False), ("is_active", T.BooleanType(), False), ("parse_confidence", T.FloatType(), False),
)
EDGES = _table(("source_id", T.StringType(), False), ("target_id", T.StringType(), False), ("type", T.StringType(), False), ("weight", T.DoubleType(), False))
ALIAS = _table(("old_id", T.StringType(), False), ("new_id", T.StringType(), False), ("root_id", T.StringType(), False), ("commit_hash", T.StringType(), False))
HISTORY = _table(("node_id", T.StringType(), False), ("commit_hash", T.StringType(), False), ("timestamp", T.LongType(), False), ("synthetic_msg", T.StringType(), True))
TRACES = _table(("trace_id", T.StringType(), False), ("node_ids", T.ArrayType(T.StringType(), False), False), ("created_at", T.LongType(), False))
VECTORS = _table(("id", T.StringType(), False), ("vector", T.ArrayType(T.FloatType(), False), False))
ANNOTATIONS = _table(("commit_hash", T.StringType(), False), ("path", T.StringType(), False), ("text", T.StringType(), False))
ERRORS = _table(("path", T.StringType(), False), ("message", T.StringType(), False), ("kind", T.StringType(), True))
TABLES = {"nodes": NODES, "edges": EDGES, "alias": ALIAS, "history": HISTORY, "traces": TRACES, "vectors": VECTORS, "annotations": ANNOTATIONS, "errors": ERRORS}
KEYS = {
    "nodes": ["id"], "edges": ["source_id", "target_id", "type"], "alias": ["old_id"], "history": ["node_id", "commit_hash"],
    "traces": ["trace_id"], "vectors": ["id"], "annotations": ["commit_hash"], "errors": ["path"],
}



def error_kind(message):
    """The name before a message's colon, as parsers write it; null without."""
    return F.nullif(F.regexp_extract(message, r"^(\w+):", 1), F.lit(""))


#: Steps between versions, reversible, each over one table: version after the step -> table -> (schema before it, up, down).
STEPS = {
    2: {"errors": (T.StructType(ERRORS.fields[:2]), lambda df: df.withColumn("kind", error_kind(df["message"])), lambda df: df.drop("kind"))},
}


def stored(name: str, version: int) -> T.StructType:
    """The schema of a table in a version."""
    if not 1 <= version <= VERSION:
        raise ValueError(f"schema version {version} is not known; this is {VERSION}")
    later = [STEPS[v][name][0] for v in range(version + 1, VERSION + 1) if name in STEPS.get(v, {})]
    return later[0] if later else TABLES[name]


def migrated(name: str, df: DataFrame, version: int, to: int = VERSION) -> DataFrame:
    """A table of one version in the schema of another, step by step; only this table is touched."""
    for v in range(version + 1, to + 1):
        df = STEPS[v][name][1](df) if name in STEPS.get(v, {}) else df
    for v in range(version, to, -1):
        df = STEPS[v][name][2](df) if name in STEPS.get(v, {}) else df
    return df.select(*stored(name, to).fieldNames())


SPAN = T.StructType([
    T.StructField("byte_start", T.LongType()), T.StructField("byte_end", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("calls", T.ArrayType(T.StringType())), T.StructField("simhash", T.LongType()),
    T.StructField("parse_confidence", T.FloatType()), T.StructField("parse_error", T.StringType()),
])
CONTEXT = T.ArrayType(T.StructType([T.StructField("nodeId", T.StringType()), T.StructField("filePath", T.StringType()), T.StructField("codeSnippet", T.StringType()), T.StructField("uncertain", T.BooleanType())]))
REQUEST = T.StructType([T.StructField("traceId", T.StringType()), T.StructField("userQuery", T.StringType()), T.StructField("requireCitations", T.BooleanType()), T.StructField("context", CONTEXT)])
CHUNK = T.StructType([T.StructField("traceId", T.StringType()), T.StructField("textDelta", T.StringType()), T.StructField("done", T.BooleanType()), T.StructField("unverifiedCitation", T.BooleanType())])
