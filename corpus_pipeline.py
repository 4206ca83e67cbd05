"""A training corpus made from the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of `docs`; the columns stay those of the
documents table up to the last stage, which returns the token ids. SQL cannot express the near-duplicate
search, the templates and the tokenizer, so `ORACLE_SQL` is None and the tests compare with plain Python.

Rows with null in any column are judged like others: a null text has no words, sentences, templates or pieces. Equal
rows are one document of the near-duplicate stage. Extra columns of `docs` travel along up to the last stage, which
returns its own. Empty tables give empty results. A stage's scratch tables go when the next stage begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthpanel.llm import chosen_path, decontamination, quality_rules, span_dedup, unigram
from hearthpanel.llm.store import saved, stage_scratch

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality rules reject."""
    with stage_scratch(spark):
        return quality_rules.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    with stage_scratch(spark):
        return chosen_path.unique_documents(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove sentences of runs that occurred before; a document that loses all of them stays with an empty text."""
    with stage_scratch(spark):
        return span_dedup.deduplicated_documents(docs)


def leaked_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold items of the benchmark."""
    with stage_scratch(spark):
        return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with whether they decode to the text again."""
    with stage_scratch(spark):
        coded = unigram.encode(docs.select("doc_id", "lang", "source", "text"), MODEL)
    return coded.select("doc_id", "lang", "source", "n_pieces", "ids", "round_trip")


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("repeated spans", repeated_spans),
    ("benchmark leaks", leaked_benchmarks),
    ("pieces", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again before the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = saved(docs, f"stage_{place}")
    return docs
