"""The corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, redaction
of secrets, and tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. Null and empty texts fail the quality rules, so later stages see none unless they
are called on their own; each then treats them as its operator documents. An empty table passes
through all stages.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.adaptive_rules import keep
from ledgerflow.llm.chosen_path import deduplicate
from ledgerflow.llm.common import table, written
from ledgerflow.llm.piece_bpe import encode
from ledgerflow.llm.trigram_secrets import redact
from ledgerflow.llm.wu_manber import decontaminate


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep(docs).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest id."""
    return deduplicate(docs).select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of the benchmark occurs."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text."""
    clean = redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and a digest of the text that they decode to."""
    return encode(docs).select("doc_id", "lang", "source", F.col("__pieces.n_tokens").alias("n_tokens"),
                               F.col("__pieces.ids").alias("ids"), F.sha2("__pieces.decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("benchmark", benchmark),
          ("secrets", secrets), ("pieces", pieces)]

#: SQL can't express the tokeniser's merges; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
