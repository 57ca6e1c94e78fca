"""One query for each text operator, with its production parameters, over whole tables; and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modeloom.llm import bloom_lm, decontaminate, filter_audit, jaccard_join, kneser_ney, language_id, line_dedup, pieces, quality_rules, simhash, suffix_dedup, token_alignment, url_filters
from modeloom.llm.frames import plain_text, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_similar(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", url_filters.fetch_day(F.col("page_id")).alias("fetched_on"))
    return url_filters.filter_urls(pages, url_filters.default_entries(spark)).select("page_id", "fetched_on", "blocked", "listed_since")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), bloom_lm.held_out_ids(F.col("doc_id"), 5, 0))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0")
    return kneser_ney.classify(table(spark, sf_dir, "documents"), trusted)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(plain_text(F.col("text")).cast("binary"), 256).alias("kept_sha256"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score_documents(table(spark, sf_dir, "documents"), bloom_lm.held_out_ids(F.col("doc_id"), 7, 2))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_jaccard_join, op3_decontamination, op4_url_filters, op5_quality_rules, op6_language_id, op7_quality_classifier, op8_sentencepiece, op9_line_dedup, op10_lm_scoring, op11_filter_audit, op12_simhash, op13_token_alignment)}

ORACLES: dict[str, str] = {"op4_url_filters": url_filters.ORACLE, "op5_quality_rules": quality_rules.ORACLE, "op9_line_dedup": line_dedup.ORACLE, "op11_filter_audit": filter_audit.ORACLE}
