"""Sessions and the folder that all processes share."""

from __future__ import annotations

import contextlib
import os
import re
import shutil
import tempfile
import threading
import time

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_made: set[str] = set()


def session(app: str = "trailhead", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``master`` only where the launcher does not set one."""
    b = SparkSession.builder.appName(app)
    b = b.master(master) if master else b
    for k, v in ({"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  A folder of our own only on a local master: on a cluster each machine would have another."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="trailhead-")
    if not known.isDefined():
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage cut in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def work_folder(spark: SparkSession) -> str:
    """The application's own folder below the shared one; it goes when the application ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/trailhead-{spark.sparkContext.applicationId}"
    if folder not in _made:
        _made.add(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return folder


@contextlib.contextmanager
def tagged(spark: SparkSession, tag: str):
    """Jobs that this thread starts inside can be stopped by ``interrupt``, as a question whose asker has gone."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in the store that stateful Python operators need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    kept = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, kept)


@contextlib.contextmanager
def batches(spark: SparkSession, rows: int):
    """Jobs that start inside hand at most ``rows`` rows at once to Python: for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, kept)


@contextlib.contextmanager
def splits(spark: SparkSession, size: int):
    """Jobs that start inside read files in splits of at most ``size`` bytes: for rows that files squeeze well."""
    name = "spark.sql.files.maxPartitionBytes"
    kept = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, kept)


def interrupt(spark: SparkSession, tag: str) -> None:
    """Cancel the running jobs of a tag; the thread that waits for them gets an error."""
    spark.sparkContext.cancelJobsWithTag(tag)


class IdleStop(threading.Thread):
    """Stops the session after ``after`` seconds without a job; looks every ``poll`` seconds."""

    def __init__(self, spark: SparkSession, after: float = 900, poll: float = 30, stop=None):
        super().__init__(daemon=True)
        self.spark, self.after, self.poll, self.stop = spark, after, poll, stop or spark.stop
        self.cancelled = threading.Event()

    def run(self) -> None:
        tracker, seen = self.spark.sparkContext.statusTracker(), time.monotonic()
        while not self.cancelled.wait(self.poll):
            if tracker.getActiveJobsIds():
                seen = time.monotonic()
            elif time.monotonic() - seen >= self.after:
                self.stop()
                return

    def cancel(self) -> None:
        self.cancelled.set()


def ship(spark: SparkSession) -> None:
    """Make the package importable on the workers, once for each application."""
    root, sc = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    if root != os.getcwd() and root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "trailhead"), "zip", root, "trailhead"))


#: Inputs of less than this and fewer files than cores are dealt over all cores before a costly map.
SMALL_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` itself, or, where its whole input is a few small files, dealt evenly over the cores.  Rows are the same."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    few = cores > 1 and size < SMALL_BYTES and len(df.inputFiles()) < cores
    return df.repartition(cores) if few else df
