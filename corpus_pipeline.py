"""Corpus pipeline: the stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
into the shared folder and read back as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskops.llm import mixing, packing, pii, quality, simhash
from riskops.llm.common import fresh, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are outliers of their language and source, go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: that with the least doc_id."""
    return simhash.one_of_each(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the texts."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted into the Pfair mix of their sources."""
    return mixing.in_mix_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, each with its sequence and place there; sequences follow the mix.

    Files promise no order of rows, so the documents' places in the mix are derived again.
    """
    order = fresh("mix_order", docs.columns)
    return packing.pack(mixing.with_place(docs, order), place=order)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("pii_sanitisation", sanitise),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Not expressible in SQL: robust estimates by concentration steps, 64-bit XXH64 shingle hashes, connected groups, the bin search and the
#: tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
