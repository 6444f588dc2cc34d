"""A corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, tokens.

Each stage is written as Parquet and read again by the next, so every stage works on what the one
before it kept, and a lost executor costs no more than a stage's tasks.

Defined results: null, empty and blank texts are rejected by the quality rules; rows without a doc_id pass
the later stages, with line dedup ranking them last; of rows that repeat doc_id and text one stays, while
unlike texts under one doc_id all do; an empty table gives an empty result; extra columns pass through, and
`n_chars`, where there is one, follows the text. Very long texts are taken whole at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspark.llm import decontamination, line_dedup, pieces, quality, simhash
from marlspark.llm.common import written
from marlspark.llm.registry import model_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.quality_filter(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines that a smaller doc_id holds."""
    done = line_dedup.dedup_lines(docs)
    if "n_chars" not in docs.columns:
        return done
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates."""
    return simhash.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, in its own words or re-parameterised."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the number of tokens and the digests of ids and decoded text."""
    return pieces.token_digests(docs, model_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece", tokenise),
]

#: SQL can express neither SimHash components nor the token ids; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
