"""Mixing sources to target weights by systematic sampling.

Sizes are words.  Each source gets a target share of all words, at most ``CAP`` times what it has; its documents are then
expected target / size times each.  Inside a source, in the order of size, the expected copies are prefix-summed from one
random offset, and a document is emitted once for each whole number that its step crosses.  So a document is taken the
expected number of times or one more or less than that, rounded, and a source's words miss the target by less than its
longest document's.

Prefix sums are over a range sort, so a source of any size is spread over many tasks: each partition sums by itself, and the
driver carries a number from one partition to the next (a row a partition).  Only small rows (id, source, size, hashes) are
sorted.  Expected copies are whole numbers of 2**-32, so sums are exact and do not depend on the partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from . import hashes, runtime

CYCLE, CAP, SEED = (5, 2, 1), 3, 13
#: Expected copies are in units of 1 / UNIT.
UNIT = 1 << 32
#: As many sources, with names of as many bytes in all, are sent to the rows whole; beyond that hot ones are.
FEW, FEW_BYTES = 1 << 14, 8 << 20
_BYTES = 4 << 20


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(_id, _s, size, _h1, _h2): id, source key, words of the whole text, hashes of the text.  Map only.

    The key is the source behind a letter, so a null source (empty key) and an empty one differ.
    """
    runtime.tune(docs.sparkSession)
    key = F.coalesce(F.concat(F.lit("="), F.make_valid_utf8(F.col(source_col).cast("string"))), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("_id"), key.alias("_s"), runtime.text(text_col).alias("_t"))
    src = src.select("_id", "_s", F.xxhash64("_t").alias("_h1"), F.xxhash64(F.lit(SEED), "_t").alias("_h2"), "_t")

    def f(batches):
        for b in batches:
            data, off = runtime.bytes_of(b.column("_t"))
            size = np.zeros(b.num_rows, np.int64)
            for p, q in runtime.pieces(off, _BYTES):
                for a in range(int(off[p]), max(int(off[q]), int(off[p]) + 1), _BYTES):  # a long text in parts
                    e = min(a + _BYTES, int(off[q]))
                    word = hashes.NOT_SPACE[data[a:e]]
                    begins = word.copy()
                    begins[1:] &= ~word[:-1]
                    inner = off[p : q + 1]
                    inner = inner[(inner > a) & (inner < e)] - a
                    begins[inner] = word[inner]
                    if a > off[p] and len(word) and hashes.NOT_SPACE[data[a - 1]]:
                        begins[0] = False  # the word began in the part before
                    at = np.flatnonzero(begins) + a
                    size += np.bincount(np.searchsorted(off, at, "right") - 1, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_id", "_s")), pa.array(size), b.column("_h1"), b.column("_h2")], ["_id", "_s", "size", "_h1", "_h2"])

    return src.mapInArrow(f, "_id long, _s string, size long, _h1 long, _h2 long")


def targets(sizes: DataFrame, cycle: tuple = CYCLE, cap: float = CAP) -> DataFrame:
    """(_s, n, source_size, weight, target) from ``sized`` rows: a row a source.

    Sources, by code point and null last, weigh ``cycle``, repeating, and share all words by weight; none gets more than
    ``cap`` times its own words, and what is over is shared again.  The level (words a unit of weight) rises until no further
    source is full: a handful of sums over the sources.  A source without words has the target 0.
    """
    spark = sizes.sparkSession
    sources = sizes.groupBy("_s").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    ranked = numbered(sources, F.col("_s") == "", F.col("_s"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in cycle)), (F.col("_rank") % len(cycle) + 1).cast("int"))
    sources = runtime.stored(ranked.select("_s", "n", "source_size", weight.alias("weight")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    most, level = F.col("source_size") * F.lit(cap), 0.0
    open_before = None
    while total:
        full = most <= F.col("weight") * F.lit(level)
        got = sources.agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w"), F.count_if(~full).alias("open")).first()
        if not got.w or got.open == open_before:
            break
        open_before, level = got.open, (total - cap * got.held) / got.w
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), most.cast("double")))


def offset(key: Column, seed: int = SEED) -> Column:
    """The random start of a source, in units of 1 / UNIT: 32 bits of a hash of its key, so that reruns agree."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("long")


def _summed(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (_s, size, _id, _h1, _h2, _e, _o) in order, with _p and _run: the sum of _e (modulo UNIT) of its source before
    the row inside partition _p, and _lead: whether that source is the partition's first."""
    order = [F.col("_s") == "", F.col("_s"), *(F.col(c) for c in ("size", "_id", "_h1", "_h2"))]
    tie = F.monotonically_increasing_id()  # rows that repeat everything are interchangeable, but need not share a task
    placed = rows.withColumn("_tie", tie).repartitionByRange(n, *order, F.col("_tie")).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())

    def f(batches):
        first = last = None
        carry = i = 0
        for b in batches:
            if not b.num_rows:
                continue
            s = b.column("_s")
            code = s.dictionary_encode()
            names, code = code.dictionary, code.indices.to_numpy()
            e = b.column("_e").to_numpy() % UNIT
            total = np.cumsum(e)
            head = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1])
            before = np.repeat(total[head] - e[head], np.diff(np.append(head, len(code))))
            run = total - e - before
            here = names[int(code[0])].as_py()
            first = here if first is None else first
            if here == last:
                run[: head[1] if len(head) > 1 else None] += carry
            last = names[int(code[-1])].as_py()
            carry = int(run[-1] + e[-1]) % UNIT
            lead = pc.equal(s, first)
            columns = ["_id", "_s", "size", "_h1", "_h2", "_e", "_o", "_p"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(run % UNIT), lead, pa.array(np.arange(i, i + b.num_rows))], [*columns, "_run", "_lead", "_i"])
            i += b.num_rows

    kind = "_id long, _s string, size long, _h1 long, _h2 long, _e long, _o long, _p int, _run long, _lead boolean, _i long"
    return runtime.stored(placed.drop("_tie").select("_id", "_s", "size", "_h1", "_h2", "_e", "_o", "_p").mapInArrow(f, kind), "runs")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple = CYCLE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """A row a document: id, source, size, source_size, target, copies, and the text's hashes (_h1, _h2).

    A null text has no words; a document without words may be emitted, but takes none.  Null ids and repeated rows are
    documents of their own, each with its copies; their order among themselves is by text hash.  Empty table: no rows.
    """
    spark = docs.sparkSession
    sizes = runtime.stored(sized(docs, id_col, text_col, source_col), "sizes")
    goal = targets(sizes, cycle, cap)
    rate = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.lit(float(UNIT)))).otherwise(0.0).cast("long")
    goal = runtime.stored(goal.withColumns({"_e": F.least(rate, F.lit(int(cap * UNIT))), "_o": offset(F.col("_s"), seed)}), "goals")
    size = goal.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_s")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    slim = goal.select("_s", "n", "_e", "_o")
    few = size[0] <= FEW and size[1] <= FEW_BYTES
    met = sizes.join(F.broadcast(slim.drop("n")), "_s") if few else runtime.lookup(sizes, slim, "_s", "n", size[2])
    runs = _summed(met, runtime.partitions(spark))

    # where a source goes on from one partition to the next, the sum goes with it: a row a partition
    e = F.col("_e") % UNIT
    end = F.struct("_s", "_run", (F.col("_run") + e).alias("sum"), "_lead")
    bounds = runs.groupBy("_p").agg(F.max_by(end, "_i").alias("last"), F.min_by("_s", "_i").alias("first")).collect()
    carry, held, name = {}, 0, None
    for p in sorted(bounds, key=lambda r: r["_p"]):
        carry[p["_p"]] = held if p["first"] == name else 0
        held = (p["last"]["sum"] + (carry[p["_p"]] if p["last"]["_lead"] else 0)) % UNIT
        name = p["last"]["_s"]
    if carry:
        known = F.broadcast(spark.createDataFrame(list(carry.items()), "_p int, _c long"))
        runs = runs.join(known, "_p")
    else:
        runs = runs.withColumn("_c", F.lit(0).cast("long"))
    at = (F.col("_run") + F.col("_o") + F.when(F.col("_lead"), F.col("_c")).otherwise(0)) % UNIT
    copies = F.shiftright(at + F.col("_e"), 32)
    placed = runs.withColumn("copies", copies)
    facts = goal.select("_s", "n", "source_size", "target")
    out = placed.join(F.broadcast(facts.drop("n")), "_s") if few else runtime.lookup(placed, facts, "_s", "n", size[2])
    source = F.when(F.col("_s") != "", F.expr("substring(_s, 2)"))
    return out.select(F.col("_id").alias(id_col), source.alias(source_col), "size", "source_size", "target", "copies", "_h1", "_h2")


def mix(docs: DataFrame, planned: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as ``plan`` says; all columns stay.

    Rows that repeat id, source and text are one document here, emitted as often as all of them together.  Documents that are
    not taken are left out before any text moves.
    """
    taken = planned.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_s"), "_h1", "_h2", "copies").groupBy("_id", "_s", "_h1", "_h2").agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    plain, names = runtime.plain(docs)
    text, ident, source = (f"_c{names.index(c)}" for c in (text_col, id_col, source_col))
    own = plain.withColumns({"_id": F.col(ident).cast("long"), "_s": F.make_valid_utf8(F.col(source).cast("string")), "_t": runtime.text(text)})
    own = own.withColumns({"_h1": F.xxhash64("_t"), "_h2": F.xxhash64(F.lit(SEED), "_t")}).drop("_t").dropDuplicates(["_id", "_s", "_h1", "_h2"])
    met = own.alias("d").join(taken.alias("t"), F.expr("d._id <=> t._id AND d._s <=> t._s AND d._h1 = t._h1 AND d._h2 = t._h2"))
    copies = met.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return copies.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)))
