"""The operators over the test tables, whole tables each, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from islet.llm import language, licenses, media, mixing, near_duplicates, oracle, packing, quality_rules, quotations, token_counts, token_files
from islet.storage import new_path, stage


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = stage(media.store(_documents(spark, sf_dir)), "media", "uncompressed")
    return media.read(stored).withColumn("feature", F.lower(F.hex("phash"))).drop("pixels", "phash")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score(_documents(spark, sf_dir).select("doc_id", "text"))
    return scored.select("doc_id", "f.n_words", "f.word_chars", "f.n_symbols", "f.n_dup_lines", "f.n_repeat_words", "base_failed", "kept", "posterior")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(_documents(spark, sf_dir))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", language.held_out())
    model = language.fit(docs.where(F.col("doc_id").isNotNull() & ~F.col("held_out")).select("text", "lang"))
    return language.predict(docs, model, carry=("doc_id", "held_out"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write(_documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return token_files.digests(spark, path)


def _tree(docs: DataFrame) -> DataFrame:
    """``doc_id, path, text``; no path without a doc_id."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.expr("doc_id div 1000"), F.expr("doc_id div 100"), F.concat("doc_id", F.lit(".txt")))
    return docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: a source's thousands, then hundreds, by doc_id. Without a doc_id they have no path."""
    return licenses.scan(_tree(_documents(spark, sf_dir)))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end=1, capacity=2048)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_pieces(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op10_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_media": op1_media,
    "op2_quality_rules": op2_quality_rules,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_language": op4_language,
    "op5_token_files": op5_token_files,
    "op6_licenses": op6_licenses,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_quotations": op10_quotations,
}
ORACLE = oracle.ORACLE
