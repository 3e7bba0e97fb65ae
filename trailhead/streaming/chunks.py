"""Answers that arrive as a stream of JSON lines, a chunk each.

A chunk has its trace's id, a piece of text, and whether it is the last.  Pieces of one trace come in the order of their lines,
within a file and over files; what has come so far is kept as state until the last one, however the lines are cut into
files, micro-batches or runs.  Lines that are no JSON object are left out; so are pieces after the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schema, session

ANSWER = "trace_id string, text string, pieces long, unverified boolean"


class _Answers(StatefulProcessor):
    """The pieces of one trace: a list until the last one has come, then only that it has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pieces = handle.getListState("pieces", "text string, unverified boolean")
        self.ended = handle.getValueState("ended", "ended boolean")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["at", "file", "line"])
        if self.ended.exists():
            return
        held, last = [], False
        for text, done, unverified in zip(new["text"], new["done"], new["unverified"]):
            held.append((text, bool(unverified)))
            if done:
                last = True
                break
        if not last:
            self.pieces.appendList(held)
            return
        every = [*(tuple(p) for p in self.pieces.get()), *held]
        self.pieces.clear()
        self.ended.update((True,))
        yield pd.DataFrame([(key[0], "".join(t for t, _ in every), len(every), any(u for _, u in every))], columns=["trace_id", "text", "pieces", "unverified"])

    def close(self) -> None:
        pass


def chunks(files: DataFrame) -> DataFrame:
    """Chunks with their places, from a text source of whole files (a file of chunks is a writer's batch)."""
    place = [F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file")]
    lines = files.select(*place, F.posexplode(F.split("value", "\n")).alias("line", "value"))
    flag = lambda n: F.coalesce(F.col(f"c.{n}"), F.lit(False))
    rows = lines.select(F.from_json("value", schema.CHUNK).alias("c"), "at", "file", "line").where("c.traceId IS NOT NULL")
    return rows.select(F.col("c.traceId").alias("trace_id"), F.coalesce("c.textDelta", F.lit("")).alias("text"), flag("done").alias("done"), flag("unverifiedCitation").alias("unverified"), "at", "file", "line")


def run(spark: SparkSession, source: str, out: str, checkpoint: str, files_per_batch: int = 1) -> None:
    """Take all files of JSON lines that have arrived, oldest first, append the answers that are whole below ``out``, and stop."""
    session.ship(spark)
    with session.rocksdb(spark):
        files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source, wholetext=True)
        done = chunks(files).groupBy("trace_id").transformWithStateInPandas(statefulProcessor=_Answers(), outputStructType=ANSWER, outputMode="Append", timeMode="None")
        done.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
