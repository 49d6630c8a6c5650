"""The operators' registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, lines, lm, repetition, secrets, simhash, suffix, toxicity, urls
from .common import documents


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(documents(spark, sf_dir, "pages").select("page_id", "url"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = documents(spark, sf_dir, "labels")
    return toxicity.score(documents(spark, sf_dir).select("doc_id", "text"), labels).drop("text")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_repetition, op2_suffix_dedup, op3_decontamination, op4_bpe, op5_lines, op6_simhash, op7_secrets, op8_urls, op9_toxicity, op10_lm)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_repetition": repetition.sql(), "op2_suffix_dedup": suffix.sql(), "op5_lines": lines.sql()}
