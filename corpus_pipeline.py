"""A corpus pipeline: documents are filtered for quality, freed of near duplicates, mixed and tokenised.

Each stage works on all that the one before kept, and each but the last returns the columns of its documents; columns
beyond doc_id, text and source only pass through, whatever their names. The mixture may hold a document more than once.

Defined results: a null or empty text is scored like any other and fails the base rules, so it goes; a null source is a
source and a host of its own; a null doc_id has no label, and of near duplicates it stays only where none has an id;
rows that repeat each other are documents of their own up to the near duplicates, of which one stays; texts of any
length go through whole; an empty table gives empty stages, and without labels every document scores 0.5 and stays.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import fair_mix, gbt_quality, prefix_bpe, quality_rules, simhash_tiles
from plumbline.llm.shared import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below a half go."""
    return gbt_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def host_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose source is rejected, go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the least id stays."""
    return simhash_tiles.keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: documents of some go, those of others come up to three times."""
    return fair_mix.resample(docs)


def tokenizing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document of the mixture: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return prefix_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", host_quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mixing),
    ("bpe_encoding", tokenizing),
]

#: The classifier and the fingerprints are beyond SQL; tests/llm/test_llm_queries.py holds the whole run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
