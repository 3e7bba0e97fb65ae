"""What the commit hook has written down, as a stream: a Python data source with offsets.

``spark.readStream.format("hook_queue").option("folder", path).load()`` has a row for each path of each entry: deletes first.
The offset is the name of the newest entry; names begin with their time, so they only grow.  Entries stay until the stream's
checkpoint has them behind it, and ``taken`` remembers how far that was; so a stream that is killed anywhere reads the same
rows again for the same batch.
"""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .files import SUFFIXES

SCHEMA = "entry string, seq long, file_path string, op string, commit_hash string"
_TAKEN = "taken"


def entries(folder: str) -> list[str]:
    """Names of the finished entries, oldest first."""
    return sorted(n[:-6] for n in os.listdir(folder) if n.endswith(".ready")) if os.path.isdir(folder) else []


def taken(folder: str) -> str:
    """The newest entry that has been dropped; empty before the first."""
    path = os.path.join(folder, _TAKEN)
    return open(path).read() if os.path.exists(path) else ""


def drop(folder: str, upto: str) -> None:
    """Forget the entries up to a name; the name is remembered first, so offsets never go back."""
    if upto > taken(folder):
        part = os.path.join(folder, f"{_TAKEN}.part")
        with open(part, "w") as f:
            f.write(upto)
        os.replace(part, os.path.join(folder, _TAKEN))
    for name in entries(folder):
        if name <= upto:
            for kind in ("changed", "deleted", "ready"):  # the last one makes it an entry
                if os.path.exists(path := os.path.join(folder, f"{name}.{kind}")):
                    os.remove(path)


def paths(folder: str, name: str, kind: str) -> list[str]:
    ends = tuple(f".{s}" for s in SUFFIXES)
    path = os.path.join(folder, f"{name}.{kind}")
    return [p for p in open(path, errors="replace").read().split("\0") if p.endswith(ends)] if os.path.exists(path) else []


class _Entry(InputPartition):
    def __init__(self, name: str):
        super().__init__(0)
        self.name = name


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"entry": ""}

    def latestOffset(self) -> dict:
        return {"entry": max([taken(self.folder), *entries(self.folder)])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Entry(n) for n in entries(self.folder) if start["entry"] < n <= end["entry"]]

    def read(self, partition: _Entry):
        with open(os.path.join(self.folder, f"{partition.name}.ready")) as f:
            commit = f.read().strip()
        rows = [("D", p) for p in paths(self.folder, partition.name, "deleted")] + [("U", p) for p in paths(self.folder, partition.name, "changed")]
        for i, (op, path) in enumerate(rows):
            yield partition.name, i, path, op, commit

    def commit(self, end: dict) -> None:
        drop(self.folder, end["entry"])


class HookQueue(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hook_queue"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["folder"])
