"""The corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, source mix.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept, and returns a
table that is written as Parquet and read again as the next one's documents. All but the last
return the columns of ``documents``; the last adds what the mix decided, one row per copy.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm import decontam, mixing, quality, secret_scan, simhash
from pricelens.llm.common import table
from pricelens.plans.registry import Entry
from pricelens.session import ensure_checkpoint_dir

MASK = "[secret]"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality.score(docs, table(spark, sf_dir, "labels"))
    return scored.filter(F.col("predicted") == 1).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest doc_id (null last), and of equal rows one.

    Groups are made of rows, told apart by a hash of doc_id and text, so that an id that stands for several texts, or none, hides no copy.
    """
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))
    groups = simhash.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"))
    group_of = groups.select(F.col("doc_id").alias("_key"), "component_id").distinct()
    named = keyed.select("_key", "doc_id").distinct().join(group_of, "_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_key")).alias("first")
    first = named.groupBy("component_id").agg(first).select("first._key")
    kept = keyed.join(first, "_key", "left_semi").dropDuplicates(["_key", "text"])  # dealt by _key already
    return kept.select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"), out="_leaks")
    return found.filter(F.size("_leaks") == 0).select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; ``n_chars`` follows the text."""
    masked = secret_scan.mask_secrets(docs, mask=MASK)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes: the document, and size, source_size, target, copies, taken, copy_no."""
    return mixing.emit(mixing.mix(docs))


STAGES = [("quality classifier", keep_quality), ("SimHash near-dedup", drop_near_duplicates),
          ("benchmark decontamination", drop_leaks), ("secret scans", mask_secrets), ("source mix", mix_sources)]
ORACLE_SQL = None  # a learned classifier and bitwise hashes of shingles are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; tables between stages go to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)


PIPELINE = {"pipeline": Entry("pipeline", run, ORACLE_SQL)}
