"""The operators' queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

import os
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from . import conversation_trie, decontaminate, divergence, license_scan, mixing, quality_model, quality_rules, simhash, suffix_dedup, token_count, token_file, url_filter, word_dedup
from .common import table

BLOCK, ALLOW = ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"]


def vocabulary_path() -> str:
    """The vocabulary file; LATTICA_VOCABULARY names another."""
    return os.environ.get("LATTICA_VOCABULARY") or import_module("public_tokenizers").path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "links")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), BLOCK, ALLOW)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.write_and_read(table(spark, sf_dir, "documents"), vocabulary_path(), end_id=1)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"), max_share=None)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(conversation_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_word_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def queries() -> dict:
    known = [op1_simhash, op2_url_filter, op3_decontaminate, op4_mix_sources, op5_suffix_dedup, op6_quality_model, op7_token_count, op8_token_file, op9_license_scan, op10_quality_rules]
    return {f.__name__: f for f in [*known, op11_conversation_trie, op12_source_divergence, op13_word_dedup]}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.oracle_sql()
