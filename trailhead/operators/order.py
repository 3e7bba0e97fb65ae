"""Places in a global order without one task that sees all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``_rank``, their place in ``order`` from 0: a range sort, and a number carried from each partition to the
    next (a row a partition on the driver)."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = session.checkpointed(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    first, total = {}, 0
    for p, c in sorted((r["_p"], r["count"]) for r in src.groupBy("_p").count().collect()):
        first[p], total = total, total + c
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_p")

    def f(batches):
        at = None
        for b in batches:
            if b.num_rows:
                at = first[b.column("_p")[0].as_py()] if at is None else at
                kept = [c for c in b.schema.names if c != "_p"]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(np.arange(at, at + b.num_rows))], [*kept, "_rank"])
                at += b.num_rows

    return src.mapInArrow(f, f"{kind}, _rank long")
