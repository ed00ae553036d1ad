"""A corpus pipeline of five stages over `documents`, each one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are
written as Parquet and read again; scratch tables that a stage leaves go when its rows are written.
The last stage returns what a training run reads: doc_id with the token ids of the masked text.

Every stage takes documents with nulls in any column, blank and very long texts, rows that repeat an
id or a whole row, further columns with any names, and empty tables: see each for what becomes of
them. ORACLE_SQL is None: SQL cannot express a convolutional
network, SimHash components or merging of byte pairs. tests/llm/test_pipeline.py holds the stages
against brute-force versions instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hustings.llm import bpe, decontaminate, langid, near_copies, secret_scan, simhash
from hustings.llm.common import Scratch, clear, remainder, scratch_tables, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and blank ones too), or whose language the network cannot tell, go.

    Rows without a lang are not learned from; where no row has one, nothing can be told and all go.
    """
    network = langid.learn(docs, remainder("doc_id", 3) != 1)
    return langid.keep_identified(docs, network)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of SimHash links the document with the smallest id stays.

    Different texts under one id are documents of their own; rows without an id form no group and stay.
    """
    return simhash.keep_one(docs)


def edited_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents alike in 0.8 of their five-word shingles the one with the smallest id stays."""
    return near_copies.keep_one(docs)


def all_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash links first, which reach equal and almost equal texts, then edited copies among what stays."""
    return edited_copies(spark, near_duplicates(spark, docs, sf_dir), sf_dir)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go; null and blank texts and an empty benchmark overlap nothing."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each secret in its text is replaced by [SECRET], and n_chars, if there, follows; a null text stays null."""
    return secret_scan.mask(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded bytes, and the ids; a null text has no tokens; other columns end here."""
    return bpe.digests(docs, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", all_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("secrets", secrets),
    ("tokens", tokens),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch, held = Scratch(spark), None
    for name, stage in STAGES:
        before = scratch_tables()
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        clear(spark, scratch_tables() - before - {scratch.base})
        if held is not None:
            scratch.drop(held)
        held = docs
    return docs
