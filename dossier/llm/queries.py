"""Queries of the training-data operators, for the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, language, licences, line_dedup, media, minhash, mixing, periodic, quality, secrets, suffixes, wordpiece
from .workspace import table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).drop("shard", "offset")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    rated = quality.rate_documents(docs, table(spark, sf_dir, "labels"), keep_text=False)
    return rated.select("doc_id", F.round("__quality", 6).alias("quality"), F.round("__toxicity", 6).alias("toxicity"), F.col("__keep").alias("keep"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_line_dedup, op3_source_mixing, op4_suffix_array_dedup, op5_secret_scan, op6_licence_scan, op7_quality_classifier, op8_decontamination, op9_token_counts, op10_minhash_near_dedup, op11_conversation_repair, op12_periodic_runs, op13_language_id)}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": line_dedup.SQL, "op3_source_mixing": mixing.SQL}
