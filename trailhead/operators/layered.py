"""Stored tables whose writes cost what changes: bucketed bases, delta layers, merge on read, versions without locks.

A table is a base, cut by key hash into buckets, and deltas: each batch writes its own newest rows with its version (``_v``)
and their buckets (``_b``), deletes as marked rows (``_gone``).  A base bucket knows the version up to which deltas are in it.  A reader takes the deltas' newest row of each key and the base's other rows; while the deltas are few this
shuffles no base row.  Every ``FAN`` deltas of a level become one of the next level, and a bucket whose deltas reach
``FULL`` of its base is folded, it alone; so a row is written a logarithmic number of times, and a batch never rewrites
what it does not touch.  Buckets follow the table's size.

A version is one manifest file that names every layer.  It appears by an operation that fails where the name exists, so of
two writers of a version, however long either has stalled, one gets ``Conflict``; nothing is claimed or leased.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema, session

#: Deltas of a level before they become one; share of a bucket's base at which its deltas are folded into it.
FAN, FULL = 8, 0.25
#: Rows of a bucket when a base is written; a table grown four times beyond that is cut anew.
BUCKET_ROWS = 1 << 18
#: Changed keys up to this many are broadcast to the base (a key is a few dozen bytes).
BROADCAST_ROWS = 100_000
#: Rows that one task sorts by key or writes, about: a vector takes 1.6 KB there, however few bytes a shuffle squeezes it to.
TASK_ROWS = 1 << 16
#: Seconds after which files that no manifest names are a failed writer's.
ORPHAN = 86_400
MOVED = T.StructType([T.StructField("_gone", T.BooleanType()), T.StructField("_v", T.LongType()), T.StructField("_b", T.IntegerType())])


class Conflict(RuntimeError):
    """Another writer has published the version."""


class Files:
    """The few file operations of the manifest, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(folder).getFileSystem(self.conf)
        self.gateway = spark.sparkContext._gateway

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> dict[str, int]:
        """Names and modification times (ms) in a folder; none if there is no such folder."""
        p = self.path(folder)
        return {s.getPath().getName(): s.getModificationTime() for s in self.fs.listStatus(p)} if self.fs.exists(p) else {}

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def create(self, name: str, text: str) -> bool:
        """Make a file with its content at once; False where there is one."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        out = self.fs.create(self.path(part), False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                local = lambda n: self.jvm.java.io.File(self.path(n).toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(local(name), local(part))
                self.fs.delete(self.path(part), False)
            else:
                kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
                none = self.gateway.new_array(kind, 1)
                none[0] = kind.NONE
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.path(part), self.path(name), none)
        except Exception:
            self.fs.delete(self.path(part), False)
            if self.fs.exists(self.path(name)):
                return False
            raise
        return True


def dealt(rows: DataFrame, count: int, *by) -> DataFrame:
    """``rows``, about ``count``, dealt by columns over as many tasks as that takes; few stay as they are."""
    return rows if count <= TASK_ROWS else rows.repartition(max(-(-count // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism), *by)


def newest(rows: DataFrame, keys: list[str], count: int = 0) -> DataFrame:
    """The row of the largest ``_v`` for each key; ``count``: about how many rows there are, if they may be many."""
    rows = dealt(rows, count, *keys)
    rest = [c for c in rows.columns if c not in keys and c != "_v"]
    best = rows.groupBy(*keys).agg(F.max(F.struct("_v", *rest)).alias("_m"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_m.{c}").alias(c) for c in rows.columns))


def overlay(base: DataFrame, changes: DataFrame, keys: list[str], few: bool = False, count: int = 0) -> DataFrame:
    """``base`` after ``changes`` (its columns and ``_gone``, one row a key).  ``few``: their keys may be broadcast;
    ``count``: about how many rows both have, if they may be many."""
    names = changes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    same = lambda: [base[k].eqNullSafe(names[f"_k{i}"]) for i, k in enumerate(keys)]
    if few or count <= TASK_ROWS:
        left = base.join(F.broadcast(names) if few else names, same(), "left_anti")
    else:  # dealt by what a join compares where keys may be null; an anti join would be moved before the dealing
        sides = lambda columns: [e for c in columns for e in (F.coalesce(c, F.lit("")), F.isnull(c))]
        base, names = dealt(base, count, *sides(keys)), dealt(names, count, *sides(names.columns)).withColumn("_met", F.lit(True))
        left = base.join(names, same(), "left").where("_met IS NULL").select(*base.columns)
    return left.unionByName(changes.where("NOT _gone").select(*base.columns))


class Store:
    """Versions of the tables of ``schema`` below a folder of any file system that Spark writes."""

    def __init__(self, spark: SparkSession, folder: str, bucket_rows: int = BUCKET_ROWS, at: int = schema.VERSION):
        """``at``: the schema version that this writer writes; older tables are read as they are and upgraded when written."""
        self.spark, self.folder, self.bucket_rows, self.at = spark, folder.rstrip("/"), bucket_rows, at
        self.files = Files(spark, self.folder)

    # --- manifests

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.folder}/manifest") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest (default: the newest); one without tables before the first."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "batch_id": -1, "tables": {}}
        return json.loads(self.files.text(f"{self.folder}/manifest/{version:012d}.json"))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def last_batch(self) -> int:
        """Largest stream batch that a version holds, -1 without."""
        return self.manifest()["batch_id"]

    def _commit(self, before: dict, tables: dict, batch_id: int) -> int:
        version = before["version"] + 1
        new = {"version": version, "batch_id": max(batch_id, before["batch_id"]), "tables": before["tables"] | tables}
        if not self.files.create(f"{self.folder}/manifest/{version:012d}.json", json.dumps(new)):
            raise Conflict(f"version {version} of {self.folder} was written meanwhile")
        return version

    # --- reading

    def _schema(self, name: str, table: dict | None) -> T.StructType:
        return schema.stored(name, table["schema"] if table else self.at)

    def _base(self, name: str, table: dict, buckets=None) -> DataFrame:
        kind = self._schema(name, table)
        paths = [p for b, (p, *_) in table["base"].items() if p and (buckets is None or int(b) in buckets)]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def _deltas(self, name: str, table: dict, deltas: list[dict], buckets=None) -> DataFrame:
        """The newest changed row of each key that is not in the base yet, with ``_gone``, ``_v`` and ``_b``."""
        kind = T.StructType([*self._schema(name, table).fields, *MOVED.fields])
        if not deltas:
            return self.spark.createDataFrame([], kind)
        rows = self.spark.read.schema(kind).parquet(*(d["path"] for d in deltas))
        folded = [table["base"].get(str(b), ["", 0, 0])[2] for b in range(table["buckets"])]
        if any(folded):
            rows = rows.where(F.col("_v") > F.element_at(F.array(*map(F.lit, folded)), F.col("_b") + 1))
        if buckets is not None:
            rows = rows.where(F.col("_b").isin(*buckets))
        return newest(rows, schema.KEYS[name], sum(sum(d["rows"].values()) for d in deltas)) if len(deltas) > 1 else rows

    def _merged(self, name: str, table: dict, buckets=None) -> DataFrame:
        base = self._base(name, table, buckets)
        n = sum(r for d in table["deltas"] for b, r in d["rows"].items() if buckets is None or int(b) in buckets)
        if not n:
            return base
        moved = self._deltas(name, table, table["deltas"], buckets).drop("_v", "_b")
        held = sum(x[1] for b, x in table["base"].items() if buckets is None or int(b) in buckets)
        return overlay(base, moved, schema.KEYS[name], n <= BROADCAST_ROWS, held + n)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as it is in a version (default: the newest), in this writer's schema; empty before its first rows."""
        table = self.manifest(version)["tables"].get(name)
        kind = schema.stored(name, self.at)
        return schema.migrated(name, self._merged(name, table), table["schema"], self.at) if table else self.spark.createDataFrame([], kind)

    # --- writing

    def _bucket(self, name: str, n: int):
        return F.pmod(F.xxhash64(*schema.KEYS[name]), F.lit(n)).cast("int")

    def _path(self, name: str, kind: str) -> str:
        return f"{self.folder}/{name}/{kind}-{uuid.uuid4().hex[:16]}"

    def _cut(self, name: str, df: DataFrame, n: int, rows: int, several: bool = False) -> tuple[str, dict[str, int]]:
        """``df``, about ``rows``, written as a base in buckets: (path, rows of each bucket that has some).

        ``several``: changed rows, of which a key may have several; they meet where they are written."""
        path, keys = self._path(name, "base"), schema.KEYS[name]
        spread = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // n, -(-rows // (TASK_ROWS * n))) if n > 1 or rows > TASK_ROWS else 1
        df = df.withColumns({"_b": self._bucket(name, n), "_p": F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(spread))})
        df = df.repartition(n * spread, "_b", "_p") if n * spread > 1 else df
        df = newest(df, ["_b", "_p", *keys]).where("NOT _gone").drop("_gone", "_v") if several else df
        df.drop("_p").write.partitionBy("_b").parquet(path)
        if not any(x.startswith("_b=") for x in self.files.names(path)):
            return path, {}
        return path, {str(r["_b"]): r["count"] for r in self.spark.read.parquet(path).groupBy("_b").count().collect()}  # a row a bucket

    def _delta(self, name: str, df: DataFrame, n: int, level: int) -> list[dict]:
        """``df`` (with ``_gone`` and ``_v``) written as a delta of a table of n buckets; none without rows."""
        path = self._path(name, "delta")
        df.withColumn("_b", self._bucket(name, n)).write.parquet(path)
        rows = {str(r["_b"]): r["count"] for r in self.spark.read.schema("_b int").parquet(path).groupBy("_b").count().collect()}  # a row a bucket
        return [{"path": path, "level": level, "rows": rows}] if rows else []

    def _new_base(self, name: str, df: DataFrame, rows: int, version: int) -> dict:
        """A table that is all base, as of a version, in buckets for about ``rows``."""
        n = max(1, min(4096, -(-rows // self.bucket_rows)))
        path, counts = self._cut(name, df, n, rows)
        want = min(4096, -(-sum(counts.values()) // self.bucket_rows))
        if want > 4 * n:  # far more rows than expected
            first, n = path, want
            path, counts = self._cut(name, self.spark.read.schema(schema.stored(name, self.at)).parquet(*(f"{first}/_b={b}" for b in counts)), n, sum(counts.values()))
            self.files.delete(first)
        return self._table(path, counts, n, version)

    def _table(self, path: str, counts: dict[str, int], n: int, version: int) -> dict:
        return {"schema": self.at, "buckets": n, "base": {b: [f"{path}/_b={b}", c, version] for b, c in counts.items()}, "deltas": []}

    def _first(self, name: str, changed: DataFrame, version: int) -> dict:
        """A table that is all base, from changed rows.  They are written as they come and counted, which says how many
        buckets and tasks they need; each meets its key's others once, in the task that writes it."""
        part = self._path(name, "changes")
        changed.write.parquet(part)
        rows = self.spark.read.schema(changed.schema).parquet(part)
        count = rows.count()
        n = min(4096, -(-count // self.bucket_rows))
        n = n if n > 4 else 1
        with session.splits(self.spark, min(128 << 20, max(1 << 20, self.files.size(part) * 8 * TASK_ROWS // max(1, count)))):
            path, counts = self._cut(name, rows, n, count, True)
        self.files.delete(part)
        return self._table(path, counts, n, version)

    def publish(self, tables: dict[str, DataFrame], batch_id: int = -1, based_on: int | None = None) -> int:
        """Write the given tables whole as a new version; the others stay as they are.

        ``based_on`` is the version that the tables were made from (default: the newest).  ``Conflict``: another writer was
        faster; read again and retry.
        """
        before = self.manifest(based_on)
        made = {}
        for name, df in tables.items():
            df = df.select(*schema.stored(name, self.at).fieldNames())
            have = before["tables"].get(name)
            rows = sum(x[1] for x in have["base"].values()) if have else 0
            made[name] = self._new_base(name, df, rows, before["version"] + 1)
        return self._commit(before, made, batch_id)

    def upsert(self, changes: dict[str, DataFrame], batch_id: int = -1, based_on: int | None = None, rows: int = 0) -> int:
        """Write changed rows (a table's columns; with ``_gone``, true for deletes) as a new version.  One row a key, or
        any of several.  A table stored under an older schema is upgraded first.  ``rows``: about how many a table's changes
        are, if they may be many."""
        before = self.manifest(based_on)
        version, made = before["version"] + 1, {}
        for name, df in changes.items():
            keys, cols = schema.KEYS[name], schema.stored(name, self.at).fieldNames()
            df = df if "_gone" in df.columns else df.withColumn("_gone", F.lit(False))
            df = df.select(*cols, F.coalesce("_gone", F.lit(False)).alias("_gone"), F.lit(version).cast("long").alias("_v"))
            table = before["tables"].get(name)
            if table and table["schema"] != self.at:
                held = sum(x[1] for x in table["base"].values())
                table = self._new_base(name, schema.migrated(name, self._merged(name, table), table["schema"], self.at), held, version - 1)
            if not table or not table["base"]:
                deltas = self._deltas(name, table, table["deltas"]).drop("_b") if table and table["deltas"] else None
                made[name] = self._first(name, df if deltas is None else deltas.unionByName(df), version)
                continue
            table = table | {"deltas": [*table["deltas"], *self._delta(name, newest(df, keys, rows), table["buckets"], 0)]}
            made[name] = self._tidied(name, table, version)
        return self._commit(before, made, batch_id)

    def _tidied(self, name: str, table: dict, version: int) -> dict:
        """Merge deltas of a level that are ``FAN``, then fold the buckets whose deltas have reached ``FULL`` of their base."""
        deltas, level = table["deltas"], 0
        while sum(d["level"] == level for d in deltas) >= FAN:  # merged deltas keep each row's version
            same = [d for d in deltas if d["level"] == level]
            merged = self._delta(name, self._deltas(name, table, same).drop("_b"), table["buckets"], level + 1)
            deltas = [d for d in deltas if d["level"] != level] + merged
            level += 1
        table = table | {"deltas": deltas}
        changed: dict[str, int] = {}
        for d in deltas:
            for b, n in d["rows"].items():
                changed[b] = changed.get(b, 0) + n
        held = {b: x[1] for b, x in table["base"].items()}
        total = sum(held.values()) + sum(changed.values())
        full = {int(b) for b, n in changed.items() if n >= FULL * held.get(b, 0)}
        if full and total > 4 * self.bucket_rows * table["buckets"]:
            return self._new_base(name, self._merged(name, table), total, version)
        if not full:
            return table
        path, rows = self._cut(name, self._merged(name, table, full), table["buckets"], sum(held.get(str(b), 0) + changed[str(b)] for b in full))
        base = {b: x for b, x in table["base"].items() if int(b) not in full} | {b: [f"{path}/_b={b}", n, version] for b, n in rows.items()}
        if emptied := [b for b in full if str(b) not in rows]:  # a bucket without rows still knows what is in it
            base |= {str(b): ["", 0, version] for b in emptied}
        left = [d | {"rows": {b: n for b, n in d["rows"].items() if int(b) not in full}} for d in deltas]
        return table | {"base": base, "deltas": [d for d in left if d["rows"]]}

    # --- housekeeping

    @staticmethod
    def _paths(manifest: dict) -> set[str]:
        tables = manifest["tables"].values()
        return {x[0].rpartition("/_b=")[0] for t in tables for x in t["base"].values() if x[0]} | {d["path"] for t in tables for d in t["deltas"]}

    def layers(self, name: str) -> dict:
        """What a table consists of now: its manifest entry."""
        return self.manifest()["tables"].get(name, {"base": {}, "deltas": [], "buckets": 1, "schema": self.at})

    def prune(self, keep: int = 2) -> list[str]:
        """Delete the manifests before the ``keep`` newest and every layer that only they name; also layers that no manifest
        has named for a day, a failed writer's.  Returns the layers' paths."""
        versions = self.versions()
        manifests = {v: self.manifest(v) for v in versions}
        held = set().union(*(self._paths(manifests[v]) for v in versions[-keep:]), set())
        gone = set().union(*(self._paths(manifests[v]) for v in versions[:-keep]), set()) - held
        old = (time.time() - ORPHAN) * 1000
        for name in schema.TABLES:
            gone |= {p for n, at in self.files.names(f"{self.folder}/{name}").items() if (p := f"{self.folder}/{name}/{n}") not in held and at < old}
        for v in versions[:-keep]:
            self.files.delete(f"{self.folder}/manifest/{v:012d}.json")
        for p in gone:
            self.files.delete(p)
        return sorted(gone)
