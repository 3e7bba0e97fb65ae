"""The corpus pipeline: quality, near copies, repeated passages, benchmark leaks, token ids.

Each stage takes what its predecessor kept, as ``documents``; its result is written as Parquet and read again.  The last
stage adds token ids.  ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailhead.llm import bpe, decontaminate, quality, runtime, simhash, substrings

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: SQL cannot express the classifier, the fingerprints' hash or the encoder; the tests compare with brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts, a score of at least 0.3, as they are."""
    model = quality.train(docs, runtime.table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("score") >= quality.THRESHOLD).drop("score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id."""
    return simhash.dedup(docs, shingle=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that start earlier; documents of which nothing is left go."""
    cut = substrings.dedup(docs)
    left = (F.col("n_removed") == 0) | (F.length("kept") > 0)
    changed = F.col("n_removed") > 0
    return cut.where(left).select(
        *(
            F.when(changed, F.col("kept")).otherwise(F.col("text")).alias("text")
            if c == "text"
            else F.when(changed, F.char_length("kept").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
            if c == "n_chars"
            else F.col(f"`{c}`")
            for c in docs.columns
        )
    )


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.clean(docs, runtime.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, as array, of the texts."""
    coded = bpe.encode(docs, public_tokenizers.path(VOCABULARY))
    return coded.withColumn("n_tokens", F.size("ids").cast("long")).drop("ends")


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("leaks", drop_leaks),
    ("tokens", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = runtime.stored(stage(spark, docs, sf_dir), name)
    return docs
