"""The simple analyzer as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokenize(text: Column) -> Column:
    """Runs of letters and numbers, each then lower-cased by itself (final sigma and all)."""
    words = F.filter(F.split(text, r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.lower(w))


def document_terms(documents: DataFrame) -> DataFrame:
    """``id, length, terms`` from ``id, text``."""
    tokens = tokenize(F.col("text"))
    return documents.select("id", F.size(tokens).cast("long").alias("length"), tokens.alias("terms"))
