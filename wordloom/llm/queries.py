"""The registered queries of this folder: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, cross_parsing, exact_dedup, fingerprint, line_dedup, mixing, packing, secrets, set_join, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"), secrets.fit(secrets.labelled_findings()))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).drop("row_file", "row_no")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.turns(chat.probe(_table(spark, sf_dir, "conversations"))))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("row_file", "row_no")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_table(spark, sf_dir, "documents")).drop("row_file", "row_no")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op7_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(_table(spark, sf_dir, "documents")).drop("row_file", "row_no")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_join(_table(spark, sf_dir, "documents")).drop("row_file", "row_no", "kept")


def op10_cross_parsing_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_parsing.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_source_mixing": op4_source_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_phrase_fingerprints": op7_phrase_fingerprints,
    "op8_line_dedup": op8_line_dedup,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_cross_parsing_score": op10_cross_parsing_score,
}

ORACLE_SQL = {
    "op3_chat_formatting": chat.ORACLE_SQL,
    "op4_source_mixing": mixing.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op9_ngram_jaccard_join": set_join.ORACLE_SQL,
}
