"""A training-data pipeline: five operators, each on what the one before it kept.

``run`` writes every stage as Parquet to the shared folder and reads it again,
so a stage restarts from files whichever executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm.decontaminate import decontaminate
from lumenframe.llm.ngram_join import keep_one
from lumenframe.llm.packed_tokens import token_file_digest
from lumenframe.llm.quality_rules import apply_quality_rules
from lumenframe.llm.source_mix import mixed_documents
from lumenframe.storage import cut_lineage, scratch

VOCABULARY = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without boilerplate lines."""
    return apply_quality_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token files; one row per document, read back from them.

    Workers remember fewer words than usual, as they hold what earlier stages left.
    """
    return token_file_digest(docs, public_tokenizers.path(VOCABULARY), memo_words=200_000)


def _tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, before which the last stage's working files go: its result has been written by then."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scratch(spark, "pipeline"):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality_rules", _tidy(quality)),
    ("near_duplicates", _tidy(near_duplicates)),
    ("decontamination", _tidy(decontamination)),
    ("mixing", _tidy(mixing)),
    ("token_files", _tidy(token_files)),
]

#: The stages are hashing, graph and tokenizer code that SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
