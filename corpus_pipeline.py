"""From raw documents to token ids: the stages in order, each written and read again before the next.

Toxic documents go; one document of each near-duplicate group stays; words of passages that stand earlier go; sources are
mixed to target weights, short ones more than once; the rest is encoded. Every stage but the last returns the columns of
documents, all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from runlattice.llm import bagminhash, mixing, prefix_bpe, substrings, toxicity
from runlattice.llm.common import stored, table
from runlattice.llm.queries import BPE_RANKS


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.first_of_each(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(docs)


def mixed_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return prefix_bpe.digests(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("repeated_passages", without_repeated_passages),
    ("source_mix", mixed_by_source),
    ("byte_bpe", encoded),
]

#: A label model, weighted signatures and byte pair merges have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
