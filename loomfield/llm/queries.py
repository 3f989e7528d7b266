"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomfield.llm import chat_format, conversation_repair, graph_search, jaccard_join, license_scan, periodic_runs, quality_rules, secret_scan, sentencepiece_codec, sharding, source_mixing, suffix_dedup, warc

#: The public vocabulary that the queries use; any other SentencePiece model file will do.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"

#: Shares of the mix's tokens that op7 aims at, of as many tokens as there are.
TARGETS = {"clean": 0.9, "low": 0.06, "toxic": 0.04}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(_table(spark, sf_dir, "documents"), sentencepiece_codec.model_bytes(spark, MODEL_PATH))


def op2_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest(_table(spark, sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.links(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.report(chat_format.with_extra(_table(spark, sf_dir, "conversations")))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), source_mixing.Mix(weights=TARGETS))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(periodic_runs.planted(_table(spark, sf_dir, "documents")))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_sentencepiece, op2_graph_search, op3_secret_scan, op4_jaccard_join, op5_quality_rules, op6_chat_format, op7_source_mixing, op8_license_scan, op9_suffix_dedup, op10_warc, op11_periodic_runs, op12_sharding, op13_conversation_repair)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_secret_scan": secret_scan.ORACLE_SQL,
        "op5_quality_rules": quality_rules.ORACLE_SQL,
        "op6_chat_format": chat_format.ORACLE_SQL,
        "op8_license_scan": license_scan.ORACLE_SQL,
        "op10_warc": warc.ORACLE_SQL,
        "op11_periodic_runs": periodic_runs.ORACLE_SQL,
        "op13_conversation_repair": conversation_repair.ORACLE_SQL,
    }
