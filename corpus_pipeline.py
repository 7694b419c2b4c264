"""From documents to shards of a training mix: five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitframe.llm.common import bucket
from splitframe.llm.decontaminate import decontaminate
from splitframe.llm.jaccard import keep_one
from splitframe.llm.mixing import mixed_documents
from splitframe.llm.quality import fit_quality
from splitframe.llm.sharding import shard
from splitframe.session import materialise

SHARDS = 40
LEAST_QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least ``LEAST_QUALITY``; a quarter of the labels is not learnt from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = labels.where(bucket(4) != 2).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return docs.where(fit_quality(docs, known).score(F.col("text")) >= LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of similar ones: five words, 0.8."""
    return keep_one(docs, k=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no item of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of the documents: whole texts, or runs of their words."""
    return mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with its shard and slot; sizes are bytes of text and 16 a row."""
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + F.lit(16)).cast("bigint")
    return shard(docs, SHARDS, F.xxhash64(text), size, F.xxhash64("doc_id"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture),
    ("shards", shards),
]

#: The classifier is beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: doc_id, text, lang, source, n_chars, shard, slot."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
