"""Packing token sequences by first-fit decreasing over a tournament tree, in randomised groups.

Each document's ids (its text by the tokenizers library, then an end id) are cut
into pieces of the sequence length and one rest. A seeded hash deals the pieces
(and so equal rows, too) to groups whose number follows the corpus; in each group the pieces, longest
first, go to the first sequence with room, which a tournament tree of remaining
capacities finds in logarithmic time. A group holds about ``GROUP_PIECES``
pieces whatever the corpus or any one document holds.

Defined results: a null text is the empty text, whose only id is the end id;
null ``doc_id`` values and repeated rows are packed like any other row; an empty
table gives an empty table; other columns are ignored. No text is cut short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.llm.shared import pieces_of, written
from findery.llm.vocab import TEXT_BYTES, LibraryEncoder, default_path, loaded

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
SEQUENCE_LENGTH = 2048
GROUP_PIECES = 8192
SEED = 23


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; ``lengths`` must already be in descending order."""
    n = len(lengths)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    full = int((lengths >= capacity).sum())
    bins[:full] = np.arange(full)
    leaves = 1
    while leaves < n - full:
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    for i in range(full, n):
        size = int(lengths[i])
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i] = full + node - leaves
        offsets[i] = capacity - tree[node]
        left = tree[node] - size
        tree[node] = left
        while node > 1:
            node //= 2
            a, b = tree[2 * node], tree[2 * node + 1]
            best = a if a > b else b
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def cut_pieces(
    documents: DataFrame, path: str, end_id: int = END_ID, length: int = SEQUENCE_LENGTH, keep_ids: bool = False
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of every piece; with ``keep_ids`` its ids as 32-bit bytes."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(LibraryEncoder, path)
        for batch in batches:
            for part in pieces_of(batch, 1, TEXT_BYTES):
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows, starts, lengths, checks, totals, ids = [], [], [], [], [], []
                for row, data in enumerate(encoder.encode_texts(texts)):
                    data += end
                    for at in range(0, len(data), 4 * length):
                        piece = data[at : at + 4 * length]
                        rows.append(row)
                        starts.append(at // 4)
                        lengths.append(len(piece) // 4)
                        checks.append(zlib.crc32(piece))
                        totals.append(len(data) // 4)
                        if keep_ids:
                            ids.append(piece)
                columns = [part.column(0).take(pa.array(rows, pa.int64()))]
                columns += [pa.array(x, pa.int64()) for x in (starts, lengths, checks, totals)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    columns.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
    return documents.select("doc_id", "text").mapInArrow(cut, schema + (", ids binary" if keep_ids else ""))


def pack(
    documents: DataFrame,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    length: int = SEQUENCE_LENGTH,
    group_pieces: int = GROUP_PIECES,
    seed: int = SEED,
    keep_ids: bool = False,
) -> DataFrame:
    """The pieces of all documents with their ``sequence_id`` and ``offset``.

    ``sequence_id`` is the group's number in the high 32 bits and the sequence's
    in the group in the low ones.
    """
    path = vocabulary or default_path(VOCABULARY)
    pieces = written(cut_pieces(documents, path, end_id, length, keep_ids), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    # by the row's place in the written table: equal rows, null ids included, spread over all groups
    dealt = pieces.withColumn("draw", F.xxhash64(F.lit(seed), F.monotonically_increasing_id())).withColumn(
        "grp", F.pmod("draw", F.lit(groups))
    )

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((group["ids_crc32"].to_numpy(), group["draw"].to_numpy(), -group["length"].to_numpy()))
        group = group.iloc[order]
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), length)
        return group.assign(sequence_id=group["grp"].to_numpy() * (1 << 32) + bins, offset=offsets).drop(columns=["draw", "grp"])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("grp").applyInPandas(fit, f"{names}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of every sequence, from pieces packed with ``keep_ids``; ids as little-endian 32-bit bytes."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda made, part: F.concat(made, part["ids"])).alias("ids"),
    )
