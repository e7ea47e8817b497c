"""Corpus pipeline: language, quality, near copies, packing.  Each stage takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's documents.  All but the last return the columns
of `documents`, and further columns as they are; the last returns the pieces of packed sequences.

In every stage texts of any length are read whole, an empty table gives an empty result, and columns that play no part
may have any name."""

from __future__ import annotations

import public_tokenizers
from provisio.llm import host_rules, packing, ppm_language, superminhash
from provisio.llm.common import stored, table
from pyspark.sql import DataFrame, SparkSession


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told.  A null or empty text and one without a letter go; repeated rows are told alike and
    stay or go together; a null id or language is no reason to go."""
    return ppm_language.keep_known(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and whose host is not rejected.  A null or empty text goes; a document without
    a host is judged by itself; repeated rows are judged each, alike; ids play no part."""
    return host_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, and of rows with that id the one with the
    least hash of the whole row, so of repeated rows one stays.  A link takes a similarity of 0.8 over five-word shingles.
    Rows of one id with different texts are different documents; a row without an id stays only if no row of its group
    has one; rows without a word (null, empty, white space) are linked with nothing and stay."""
    return superminhash.keep_one(docs, percent=80, unique_ids=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-token sequences.  A null or empty text is its end token alone; repeated rows are packed each; a null
    id is carried; which sequence a piece lies in is free, so ties need no rule."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("quality_rules", quality), ("near_dedup", near_dedup), ("packing", packed)]

#: Tokenization can't be said in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
