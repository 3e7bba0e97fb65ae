"""Commits of a git repository: a Python data source over the git command, and snapshot differences as joins.

``spark.read.format("git_changes").option("repo", path).load()`` has a row for each path that a commit adds or modifies
against its first parent, newest commit first by topology and time (``topo``).  Partitions are runs of commits.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import SUFFIXES

SCHEMA = "commit_hash string, parent string, timestamp long, author string, message string, topo long, status string, file_path string, content binary"
#: Fixed value: the text of a history row and of a note.
MESSAGE = "Structural mutation detected"


def _git(repo: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True)
    if done.returncode:
        raise ValueError(done.stderr.decode(errors="replace").strip())
    return done.stdout


class _Blobs:
    """Blobs by id from one process, started with the first."""

    def __init__(self, repo: str):
        self.repo, self.process = repo, None

    def get(self, blob: str) -> bytes:
        if self.process is None:
            self.process = subprocess.Popen(["git", "-C", self.repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        self.process.stdin.write(blob.encode() + b"\n")
        self.process.stdin.flush()
        head = self.process.stdout.readline().split()
        if len(head) != 3:
            raise ValueError(f"no blob {blob} in {self.repo}")
        data = self.process.stdout.read(int(head[2]))
        self.process.stdout.read(1)
        return data

    def close(self) -> None:
        if self.process:
            self.process.stdin.close()
            self.process.wait()


class _Run(InputPartition):
    def __init__(self, commits):
        super().__init__(0)
        self.commits = commits


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.repo, self.run = options["repo"], int(options.get("commitspertask", 256))

    def partitions(self):
        log = _git(self.repo, "log", "--topo-order", "--format=%H%x1f%P%x1f%ct%x1f%an%x1f%B%x1e").decode(errors="replace")
        rows = [r.lstrip("\n").split("\x1f") for r in log.split("\x1e") if r.strip()]
        commits = [(h, p.split(" ")[0] if p else None, int(t), a, m.rstrip("\n"), i) for i, (h, p, t, a, m) in enumerate(rows)]
        return [_Run(commits[i : i + self.run]) for i in range(0, len(commits), self.run)] or [_Run([])]

    def read(self, partition):
        blobs = _Blobs(self.repo)
        try:
            yield from self._rows(partition, blobs)
        finally:
            blobs.close()

    def _rows(self, partition, blobs):
        for h, parent, ts, author, message, topo in partition.commits:
            base = parent or _git(self.repo, "hash-object", "-t", "tree", "/dev/null").decode().strip()
            raw = _git(self.repo, "diff-tree", "-r", "-z", "--no-renames", "--diff-filter=AM", base, h).split(b"\0")
            for meta, path in zip(raw[::2], raw[1::2]):
                blob, status = meta.split(b" ")[3].decode(), meta.split(b" ")[4].decode()
                if meta.split(b" ")[1] == b"160000":  # a submodule has no blob here
                    continue
                yield h, parent, ts, author, message, topo, status, path.decode(errors="replace"), blobs.get(blob)


class GitChanges(DataSource):
    @classmethod
    def name(cls):
        return "git_changes"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def changes(spark: SparkSession, repo: str) -> DataFrame:
    spark.dataSource.register(GitChanges)
    return spark.read.format("git_changes").option("repo", repo).load()


def diff(parent: DataFrame, current: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key…, status): added, modified or deleted between two snapshots; unchanged keys have no row."""
    a = parent.select(*(F.col(k).alias(f"_p{k}") for k in key), F.col(value).alias("_old"), F.lit(1).alias("_a"))
    b = current.select(*key, F.col(value).alias("_new"), F.lit(1).alias("_b"))
    on = [F.col(k) == F.col(f"_p{k}") for k in key]
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "modified")
    both = a.join(b, on, "full_outer")
    return both.select(*(F.coalesce(k, f"_p{k}").alias(k) for k in key), status.alias("status")).where("status IS NOT NULL")


def history_rows(spans: DataFrame) -> DataFrame:
    """(node_id, commit_hash, timestamp, synthetic_msg, message) for spans of commits; the live tables are not touched."""
    return spans.select("node_id", "commit_hash", "timestamp", F.lit(MESSAGE).alias("synthetic_msg"), "message").distinct()


def annotations(spans: DataFrame) -> DataFrame:
    """(commit_hash, path, text): one note a commit, for its first path."""
    first = spans.groupBy("commit_hash").agg(F.min("file_path").alias("path"))
    return first.withColumn("text", F.concat(F.lit(MESSAGE + " in "), "path"))


def staged(repo: str) -> tuple[list[str], list[str]]:
    """(changed, deleted) source files in the index against HEAD; a rename is a change of the new path."""
    ends = tuple(f".{s}" for s in SUFFIXES)
    names = lambda f: [p.decode(errors="replace") for p in _git(repo, "diff", "--cached", "--name-only", "-z", f"--diff-filter={f}").split(b"\0") if p]
    return tuple([p for p in names(f) if p.endswith(ends)] for f in ("ACMR", "D"))


def head(repo: str) -> str:
    """The present commit; "LIVE" before the first one."""
    try:
        return _git(repo, "rev-parse", "HEAD").decode().strip()
    except ValueError:
        return "LIVE"
