"""The registered queries: each applies one operator to its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthpanel.llm import (alignment, chosen_path, decontamination, licenses, merkle, partition_join, quality_rules, sharding, span_dedup, sql, token_counts,
                               toxicity, unigram, url_filter)
from hearthpanel.llm.registry import QUERIES, SQL, query  # noqa: F401

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
SHARDS = 24


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_token_counts")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), MODEL)


@query("op4_sentencepiece")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = unigram.encode(docs, MODEL)
    return coded.select("doc_id", "n_pieces", "ids", "round_trip")


@query("op7_sharding")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_rows(table(spark, folder, "documents"), SHARDS)


@query("op5_quality_rules", sql.QUALITY_RULES)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op10_license_scan", sql.LICENSE_SCAN)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_url_filter")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"))


@query("op1_span_dedup", sql.SPAN_DEDUP)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = span_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_sentences", "n_removed", found.clean.alias("text"))


@query("op3_decontamination")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.judge(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_near_dedup", sql.NEAR_DEDUP)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.judge(table(spark, folder, "documents"))


@query("op13_merkle_manifest", sql.MERKLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.judge(table(spark, folder, "documents"))


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.judge(table(spark, folder, "documents"), BYTE_VOCABULARY, MODEL)


@query("op11_partition_join", sql.PARTITION_JOIN)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return partition_join.joined(table(spark, folder, "documents"))
