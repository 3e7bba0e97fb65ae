"""The engine's tables as projections of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..functions import text
from ..operators import layered


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tagged(tag: str, c: Column) -> Column:
    return F.concat(F.lit(f"{tag}:"), c.cast("string"))


def buys(spark: SparkSession, d: str) -> DataFrame:
    """customer → part, weighted by order lines; in as many tasks as the lines ask for, since a shuffle squeezes them well."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = read(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    n = li.count() // 8  # a line is a tenth of what a task's rows may be
    ends = layered.dealt(o, n, "o_orderkey").join(layered.dealt(li, n, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).select(tagged("c", F.col("o_custkey")).alias("source_id"), tagged("p", F.col("l_partkey")).alias("target_id"))
    return (
        layered.dealt(ends, n, "source_id", "target_id").groupBy("source_id", "target_id")
        .agg(F.count("*").cast("double").alias("weight"))
        .select("source_id", "target_id", F.lit("CALLS").alias("type"), "weight")
    )


def supplied(spark: SparkSession, d: str) -> DataFrame:
    """part → supplier, weighted by order lines."""
    li = read(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    return (
        li.groupBy(tagged("p", F.col("l_partkey")).alias("source_id"), tagged("s", F.col("l_suppkey")).alias("target_id"))
        .agg(F.count("*").cast("double").alias("weight"))
        .select("source_id", "target_id", F.lit("CALLS").alias("type"), "weight")
    )


def trade(spark: SparkSession, d: str) -> DataFrame:
    return buys(spark, d).unionByName(supplied(spark, d))


def prints(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, lang, source, simhash) of documents."""
    return text.simhash_of_text(read(spark, d, "documents").select("doc_id", "lang", "source", "text"), "text").select("doc_id", "lang", "source", "simhash")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as nodes; the confidence is the quality label, 0 without."""
    docs = text.simhash_of_text(read(spark, d, "documents").select("doc_id", "source", "text"), "text")
    labels = read(spark, d, "labels").select(F.col("doc_id").alias("_d"), "quality")
    return docs.join(labels, docs.doc_id == labels._d, "left").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("file_path"), F.lit(0).cast("long").alias("byte_start"), F.octet_length("text").cast("long").alias("byte_end"),
        "simhash", F.lit(True).alias("is_active"), F.coalesce("quality", F.lit(0)).cast("float").alias("parse_confidence"),
    )


def same(spark: SparkSession, d: str) -> DataFrame:
    """document → the first one with its fingerprint."""
    p = session.checkpointed(prints(spark, d).select("doc_id", "simhash"))
    met = p.join(p.groupBy("simhash").agg(F.min("doc_id").alias("first")), "simhash").where("doc_id <> first")
    return met.select(F.col("doc_id").cast("string").alias("source_id"), F.col("first").cast("string").alias("target_id"), F.lit("SAME").alias("type"), F.lit(2.0).alias("weight"))


def following(spark: SparkSession, d: str) -> DataFrame:
    """document → the next one, and → the first one with its fingerprint."""
    i = read(spark, d, "documents").select("doc_id").distinct()
    after = i.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("next"))
    steps = i.join(after, "doc_id").select(F.col("doc_id").cast("string").alias("source_id"), F.col("next").cast("string").alias("target_id"), F.lit("NEXT").alias("type"), F.lit(1.0).alias("weight"))
    return steps.unionByName(same(spark, d))


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth customer."""
    return read(spark, d, "customer").where("c_custkey % 50 = 0").select(tagged("c", F.col("c_custkey")).alias("seed"))


def trade_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Customers, parts and suppliers as nodes."""

    def made(table: str, tag: str, key: str, path: Column, name: str, sure: str) -> DataFrame:
        return read(spark, d, table).select(
            tagged(tag, F.col(key)).alias("id"), path.alias("file_path"), F.lit(0).cast("long").alias("byte_start"), F.octet_length(name).cast("long").alias("byte_end"),
            F.lit(0).cast("long").alias("simhash"), F.lit(True).alias("is_active"), F.expr(sure).cast("int").cast("float").alias("parse_confidence"),
        )

    return (
        made("customer", "c", "c_custkey", F.col("c_mktsegment"), "c_name", "c_acctbal > 0")
        .unionByName(made("part", "p", "p_partkey", F.col("p_brand"), "p_name", "p_size >= 25"))
        .unionByName(made("supplier", "s", "s_suppkey", F.lit("supplier"), "s_name", "s_acctbal > 0"))
    )
