"""Corpus pipeline: quality rules, near-dedup, secret scans, mixing, byte-level BPE.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchwater.llm import bpe, mixing, neardup, quality, secrets
from catchwater.llm.common import scratch, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base test or a learned rule: null, empty and short texts fail the base test.

    Rows are judged each on its own: repeated rows and null ids stay or go by their text. An empty table gives none; other
    columns pass unread, whatever their names.
    """
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules, keep=True).where("kept").select("__row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, one of the smallest doc_id; repeated rows and rows with a null id are copies as others.

    Rows without words (null and empty texts among them) are no group and stay. An empty table gives none.
    """
    return neardup.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces found secrets by a mark; every row stays, repeated ones too, null and empty texts as they are. n_chars follows the text."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by their calibrated probabilities. Null sources and languages count as 'unknown', null texts as one word.

    Rows with one id are drawn alike, repeated rows so too; null ids as one id. An empty table gives none.
    """
    return mixing.mix(docs, keep=True).where("kept").select("__row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of the ids and of the decoded bytes, and ids, for each row; null texts as empty ones, repeated rows stay."""
    return bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, ids=True)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix_sources", mix_sources), ("encode", encode)]
ORACLE_SQL = None  # sketches, novelty and merges are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each reading what the one before has written. Empty documents give no rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
