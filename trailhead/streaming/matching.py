"""Matching of function shapes over a stream: the state is what has been seen of each fingerprint.

A row is a span that appears (op U) or goes (op D).  Fingerprints are dealt over ``SHARDS`` keys of one stateful operator, so a
call of it has the rows of many.  A shard's state is a list of parts, each the entries that a batch changed (fingerprint,
file, id of the active node, null where it has gone), as JSON: a batch reads a touched shard's parts at once and appends one;
parts that are many, or mostly outdated, become one.  State lies in the checkpoint, so a stream that ends and starts again goes
on as if it had not, and any cut into micro-batches gives the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import session
from ..operators.ingest import node_id

#: A span's change: the fingerprint and the id that a node of this shape has in this file.
SPAN = "seq long, file_path string, op string, simhash long, own_id string"
MATCHED = "seq long, file_path string, simhash long, id string, is_new boolean, renamed_from string"


#: Keys that the fingerprints are dealt over (a checkpoint is bound to it); parts of a shard's state, and entries of a part.
SHARDS, PARTS, PART_ENTRIES = 1024, 8, 1 << 14


class _Shapes(StatefulProcessor):
    """Active files of a shard's fingerprints: fingerprint -> path -> id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getListState("parts", "part string")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["seq", "op", "file_path"])  # deletes come before upserts of the same change
        parts = [json.loads(x[0]) for x in self.parts.get()]
        files: dict = {}  # shape -> path -> id
        for shape, path, i in (e for part in parts for e in part):
            if i is None:
                files.get(shape, {}).pop(path, None)
            else:
                files.setdefault(shape, {})[path] = i
        least: dict = {}  # shape -> its least id, where it is known
        before, out = {}, []
        for seq, path, op, own, shape in zip(new["seq"], new["file_path"], new["op"], new["own_id"], new["shape"]):
            held = files.setdefault(shape, {})
            known = held.get(path)
            before.setdefault((shape, path), known)
            if op == "D":
                if held.pop(path, None) == least.get(shape):
                    least.pop(shape, None)
                continue
            other = None
            if known is None and held:
                other = least[shape] if shape in least else min(held.values())
            if known is None:
                held[path] = own
                least[shape] = own if other is None else min(own, other)
            out.append((seq, path, None if shape is None else int(shape), held[path], known is None, other if other != held[path] else None))
        changed = [(shape, path, files[shape].get(path)) for (shape, path), i in before.items() if files[shape].get(path) != i]
        live, kept = sum(map(len, files.values())), sum(map(len, parts))
        if len(parts) >= PARTS + live // PART_ENTRIES or kept > 2 * live + PART_ENTRIES:
            every = [(shape, path, i) for shape, held in files.items() for path, i in held.items()]
            self.parts.put(self._cut(every)) if every else self.parts.clear()
        elif changed:
            self.parts.appendList(self._cut(changed))
        found = pd.DataFrame(out, columns=["seq", "file_path", "simhash", "id", "is_new", "renamed_from"])
        yield found.assign(simhash=pd.array([r[2] for r in out], dtype="Int64"))

    @staticmethod
    def _cut(entries: list) -> list[tuple]:
        return [(json.dumps(entries[at : at + PART_ENTRIES]),) for at in range(0, len(entries), PART_ENTRIES)]

    def close(self) -> None:
        pass


def spans(changes: DataFrame) -> DataFrame:
    """``changes`` (seq, file_path, op, simhash) with the id of a new node."""
    return changes.select("seq", "file_path", "op", "simhash", node_id(F.col("file_path"), F.col("simhash")).alias("own_id"))


def matched(changes: DataFrame) -> DataFrame:
    """A streaming ``changes`` (``SPAN``) as rows (``MATCHED``): an active shape of the same file keeps its node; else the node
    is new, and renamed from the least id that has the shape elsewhere."""
    # a shape comes to Python as text: a column of numbers with a null would be of floats
    dealt = changes.select(F.pmod(F.xxhash64("simhash"), F.lit(SHARDS)).alias("shard"), "seq", "file_path", "op", F.col("simhash").cast("string").alias("shape"), "own_id")
    return dealt.groupBy("shard").transformWithStateInPandas(statefulProcessor=_Shapes(), outputStructType=MATCHED, outputMode="Append", timeMode="None")


def run(spark: SparkSession, source: str, out: str, checkpoint: str, files_per_batch: int = 1) -> None:
    """Match all change files (Parquet, ``SPAN``) that have arrived, oldest first, append the rows below ``out``, and stop."""
    session.ship(spark)
    with session.rocksdb(spark):
        stream = spark.readStream.schema(SPAN).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        matched(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
