"""The queries of these operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitegrain.llm import chat, collocations, language_id, language_model, lines, minhash, mixing, ngram_join, outliers, surrogates, url_words, whitening, winnowing
from sitegrain.llm.common import table
from sitegrain.plans.staging import Staging


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(table(spark, sf_dir, "documents"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.surrogate_report(table(spark, sf_dir, "documents"), Staging(spark, "op2"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"), Staging(spark, "op3"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_report(table(spark, sf_dir, "documents"), Staging(spark, "op4"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"), Staging(spark, "op5"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Staging(spark, "op6"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"), Staging(spark, "op7"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.component_report(table(spark, sf_dir, "documents"), Staging(spark, "op8"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_words.judge(table(spark, sf_dir, "pages"), Staging(spark, "op9"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_report(table(spark, sf_dir, "documents"), Staging(spark, "op10"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), Staging(spark, "op11"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), Staging(spark, "op12"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), Staging(spark, "op13"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_surrogates, op3_mixing, op4_quality, op5_chat, op6_decontamination,
        op7_line_dedup, op8_ngram_join, op9_url_filter, op10_language_model,
        op11_minhash, op12_collocations, op13_whitening,
    )
}
