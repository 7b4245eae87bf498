"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token's bytes are a linked list; a heap holds its adjacent pairs by the
rank of their merge. The lowest pair is popped and merged until none is left.
The count is the number of bytes less the number of merges: no token ids are
made. Pre-tokens repeat, so each worker keeps counts in a cache of bounded size.

Defined results: a null text has 0 bytes and 0 tokens; an empty table gives an
empty table; repeated rows are counted each; other columns are ignored. A text
of any length is counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.llm.vocab import HeapBpe, default_path, loaded

VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def count_tokens(
    documents: DataFrame,
    vocabulary: str | None = None,
    limit: int = TOKEN_LIMIT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, without a shuffle.

    ``vocabulary`` is the path of a word-BPE file that every executor has.
    """
    path = vocabulary or default_path(VOCABULARY)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(HeapBpe, path)
        for batch in batches:
            counts = [bpe.count(t.as_py()) if t.is_valid else 0 for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    source = documents.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_column).alias("text"),
    )
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > F.lit(limit)
    )
