"""From documents to packed sequences: quality rules, near-dedup, repeated strings, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before
it kept. The first four return the columns of ``documents``; packing returns the
pieces of the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from findery.llm import mixing, near_dedup, packing, quality, suffix_dedup
from findery.llm.shared import discard, read_table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go, and documents that the rules reject."""
    return quality.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dedup.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of strings of 200 bytes that repeat, the first copy stays."""
    return suffix_dedup.keep_first_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their place in them."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("mixing", source_mix),
    ("packing", packed_sequences),
]

#: Order MinHash, byte spans and first-fit packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written once and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        docs = written(out, f"stage-{number}")
        if before is not None:
            discard(before)
        before = docs
