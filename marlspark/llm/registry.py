"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlspark.llm import conversation_trie, decontamination, fill_middle, html_text, language, line_dedup, pieces, quality, sharding, simhash, substring_dedup, suffix_dedup, urls
from marlspark.llm.common import table


def model_path() -> str:
    """The vocabulary file of the public BPE model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_digests(table(spark, sf_dir, "documents"), model_path())


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.html_report(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_report(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_report(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_report(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_middle_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_decontamination": op2_decontamination,
        "op3_sharding": op3_sharding,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_html_text": op5_html_text,
        "op6_line_dedup": op6_line_dedup,
        "op7_url_filters": op7_url_filters,
        "op8_language_id": op8_language_id,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_simhash": op10_simhash,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_fill_middle": op13_fill_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.SQL,
        "op6_line_dedup": line_dedup.SQL,
        "op7_url_filters": urls.SQL,
        "op11_substring_dedup": substring_dedup.SQL,
        "op12_conversation_trie": conversation_trie.SQL,
        "op13_fill_middle": fill_middle.SQL,
    }
