"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Defined cases: null and empty texts, and those of under ten words, fail the quality rules; rows without an id are judged, are
no near copies of others, and stay; of repeated rows one stays, and texts that share an id are documents of their own; extra
columns pass through all stages but the last, which returns its own. Empty tables give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm import jaccard_join, quality_rules, secret_scan, sentencepiece_codec, source_mixing
from loomfield.llm.common import shared_folder
from loomfield.llm.queries import MODEL_PATH


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs, _labels(spark, sf_dir))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by their kind."""
    return secret_scan.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix: no document twice, and of low-quality and toxic text half of its expected tokens."""
    mix = source_mixing.Mix(factors={"clean": 1.0, "low": 0.5, "toxic": 0.5}, max_rate=1.0)
    return source_mixing.sample(docs, _labels(spark, sf_dir), mix)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    named = docs.select("doc_id", "lang", "source", "text")
    done = sentencepiece_codec.encode(named, sentencepiece_codec.model_bytes(spark, MODEL_PATH), keep_text=False)
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_copies), ("secret scan", secrets), ("source mixing", mixing), ("SentencePiece encoding", tokens)]

#: The stages search, group and fit, which one SQL statement can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_folder(spark)}/tables/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
