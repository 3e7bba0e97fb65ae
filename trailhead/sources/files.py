"""Source files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("cpp", "h", "hpp", "cc", "py")


def is_source(path: Column) -> Column:
    return path.rlike(rf"\.({'|'.join(SUFFIXES)})$")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(file_path relative to root, content) of all source files below ``root``, outside hidden store and git folders.

    Listing and reading are Spark's: any file system, one task for a few files.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(SUFFIXES)}}}").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    kept = raw.where(~F.col("path").contains("/.git/") & ~F.col("path").contains("/.trailhead/"))
    return kept.select(F.substring(F.col("path"), F.lit(len(full) + 2), F.lit(2**31 - 1)).alias("file_path"), "content")


def load(files: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (file_path, …) with the files' content; null where the file is gone."""
    return changes.join(files.select("file_path", "content"), "file_path", "left")
