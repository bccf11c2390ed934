"""The registered queries of the corpus operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from catchwater.llm import align, base_sql, bpe, chat, media, mixing, neardup, packing, pii, quality, secrets, tokencount, vectorcodes, warc
from catchwater.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.find(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digests(pii.find(docs, pii.train(docs)))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), groups=False)[0]


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False)


# The columns of some of these that SQL can express, so that the two can be held against each other.
def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_quality_rules(spark, sf_dir).drop("kept", "rule")


def bpe_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def secret_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_secrets(spark, sf_dir).drop("spans")


def pii_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_pii(spark, sf_dir).drop("spans")


OPERATORS = (op1_quality_rules, op2_byte_bpe, op3_token_counts, op4_secrets, op5_near_dedup, op6_warc, op7_media, op8_chat, op9_pii, op10_mixing, op11_vector_codes, op12_alignment, op13_packing)
QUERIES = {f.__name__: f for f in (*OPERATORS, quality_statistics, bpe_decoded, secret_bases, pii_bases)}
ORACLE_SQL: dict[str, str] = {
    "op5_near_dedup": neardup.FIND_SQL, "op6_warc": warc.ROUND_TRIP_SQL, "op7_media": base_sql.MEDIA_SQL, "op8_chat": chat.RENDER_SQL, "op10_mixing": mixing.MIX_SQL, "op11_vector_codes": vectorcodes.compress_sql(),
    "quality_statistics": base_sql.QUALITY_SQL, "bpe_decoded": base_sql.DECODED_SQL, "secret_bases": base_sql.SECRET_SQL, "pii_bases": base_sql.PII_SQL,
}
