"""A corpus from documents to token files: filter, deduplicate, decontaminate, mix, encode.

Every stage takes the rows its predecessor kept. All but the last return the columns of
``documents``; the last returns the digests of the token files it wrote.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stringloom.llm import decontaminate, mixing, quality, simhash, tokens
from stringloom.llm.common import read_table, stage

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies."""
    return simhash.keep_first(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and as far, as the mix takes them."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: a row per row of the mix."""
    return tokens.token_digests(docs, TOKENIZER)


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", first_copies),
    ("benchmark decontamination", clean_documents),
    ("mixing sources to target weights", mixed_documents),
    ("token-ID / binary output", token_files),
]

# The classifier, the fingerprints and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written once and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stage(docs, f"stage{number}")
    return docs
