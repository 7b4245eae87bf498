"""Token ids in a content-addressed store.

A document's ids are cut where a rolling hash of the last ``WINDOW`` ids says
so, so equal passages give equal chunks wherever they stand. The store is a
folder of Parquet tables:

* ``chunks``: ``digest`` (SHA-256 of ``data``), ``data`` (ids of 2 or 4 bytes,
  little-endian); a chunk is stored once;
* ``recipes/kind=document``: in ascending ``doc_id`` order, by parts: the
  digests and lengths of a document's chunks, their Merkle root and the ids
  before the document in its part;
* ``recipes/kind=part``: documents, ids and Merkle root of each part;
* ``manifest``: one row with the vocabulary's id width, the totals and the
  Merkle root over the parts.

Readers check every chunk against its digest, every document against its root
and length, and the parts against the manifest, and raise on a difference.

Defined results: a null text is the empty text (only the end id); a null
``doc_id`` comes first; repeated rows are documents of their own; an empty table
makes an empty store. No text is cut short, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.llm.shared import delete_path, fresh_path, pieces_of
from findery.llm.vocab import TEXT_BYTES, LibraryEncoder, default_path, loaded, release

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
WINDOW = 16
#: Fixed values of the rolling hash: an odd multiplier and a finishing multiplier.
MULTIPLIER = 0x9E3779B97F4A7C15
FINISH = 0xD6E8FEB86659FD93
#: Mean, least and most ids of a chunk.
MEAN_IDS, LEAST_IDS, MOST_IDS = 512, 64, 4096
#: Rows of a part of the recipes.
PART_DOCUMENTS = 50_000
FORMAT = 1


class StoreError(ValueError):
    """The store's files don't give what its manifests say."""


def cut_points(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """For documents laid end to end (``ends``: each one's last position + 1), the ends of their chunks."""
    h = ids.astype(np.uint64)
    power, span = np.uint64(MULTIPLIER), 1
    with np.errstate(over="ignore"):
        while span < WINDOW:
            shifted = np.zeros_like(h)
            shifted[span:] = h[:-span]
            h = h + shifted * power
            power = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)
            span *= 2
        marks = (h * np.uint64(FINISH)) >> np.uint64(40)
    marked = np.flatnonzero(marks % np.uint64(MEAN_IDS) == 0) + 1
    out, start = [], 0
    lows = np.searchsorted(marked, np.concatenate(([0], ends[:-1])) + WINDOW)
    highs = np.searchsorted(marked, ends)
    for low, high, end in zip(lows.tolist(), highs.tolist(), ends.tolist(), strict=True):
        cuts, last = [], start
        for at in [*marked[low:high].tolist(), end]:
            while at - last > MOST_IDS:
                last += MOST_IDS
                cuts.append(last)
            if at == end or at - last >= LEAST_IDS:
                if at > last:
                    cuts.append(at)
                last = at
        out.append(cuts)
        start = end
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node goes up as it is, no leaves give the hash of nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        paired = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = paired + level[len(level) - len(level) % 2 :]
    return level[0]


def _encoded(documents: DataFrame, path: str, end_id: int, width: int) -> DataFrame:
    """Recipe rows (kind ``document``) and chunk rows (kind ``chunk``, once in a task)."""
    stored = np.dtype(f"<u{width}")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(LibraryEncoder, path)
        seen: set[bytes] = set()
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for part in pieces_of(batch, 1, TEXT_BYTES):
                texts = [t or "" for t in part.column(1).to_pylist()]
                streams = [data + end for data in encoder.encode_texts(texts)]
                ids = np.frombuffer(b"".join(streams), dtype="<u4")
                ends = np.cumsum([len(s) // 4 for s in streams])
                raw = ids.astype(stored).tobytes()
                digests, lengths, tokens, roots, chunk_digests, chunk_data = [], [], [], [], [], []
                start = 0
                for cuts in cut_points(ids, ends):
                    own, sizes, begun = [], [], start
                    for at in cuts:
                        data = raw[start * width : at * width]
                        digest = hashlib.sha256(data).digest()
                        if digest not in seen:
                            seen.add(digest)
                            chunk_digests.append(digest)
                            chunk_data.append(data)
                        own.append(digest)
                        sizes.append(at - start)
                        start = at
                    digests.append(own)
                    lengths.append(sizes)
                    tokens.append(start - begun)
                    roots.append(merkle_root(own))
                if len(seen) > 200_000:
                    seen.clear()
                n, m = len(texts), len(chunk_data)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["document"] * n + ["chunk"] * m),
                        pa.concat_arrays([part.column(0), pa.nulls(m, part.column(0).type)]),
                        pa.array([*tokens, *[None] * m], pa.int64()),
                        pa.array([*roots, *[None] * m], pa.binary()),
                        pa.array([*digests, *[None] * m], pa.list_(pa.binary())),
                        pa.array([*lengths, *[None] * m], pa.list_(pa.int32())),
                        pa.array([*[None] * n, *chunk_digests], pa.binary()),
                        pa.array([*[None] * n, *chunk_data], pa.binary()),
                    ],
                    ["kind", "doc_id", "n_tokens", "root", "digests", "lengths", "digest", "data"],
                )

    id_type = documents.schema["doc_id"].dataType.simpleString()
    schema = (
        f"kind string, doc_id {id_type}, n_tokens long, root binary, digests array<binary>, lengths array<int>, "
        "digest binary, data binary"
    )
    return documents.select("doc_id", "text").mapInArrow(encode, schema)


def _in_parts():
    names = ["kind", "part", "place", "doc_id", "before", "n_tokens", "root", "digests", "lengths", "documents"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, place, before, roots, kind = TaskContext.get().partitionId(), 0, 0, [], None
        for batch in batches:
            n, kind = batch.num_rows, batch.column(0).type
            tokens = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            cumulated = before + np.cumsum(tokens)
            roots += batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["document"] * n),
                    pa.array([part] * n, pa.int32()),
                    pa.array(range(place, place + n), pa.int64()),
                    batch.column(0),
                    pa.array(cumulated - tokens, pa.int64()),
                    batch.column(1),
                    batch.column(2),
                    batch.column(3),
                    batch.column(4),
                    pa.nulls(n, pa.int64()),
                ],
                names,
            )
            place += n
            before = int(cumulated[-1]) if n else before
        if kind is None:  # no rows, and so no id type either
            return
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(["part"]),
                pa.array([part], pa.int32()),
                pa.nulls(1, pa.int64()),
                pa.nulls(1, kind),
                pa.nulls(1, pa.int64()),
                pa.array([before], pa.int64()),
                pa.array([merkle_root(roots)], pa.binary()),
                pa.nulls(1, pa.list_(pa.binary())),
                pa.nulls(1, pa.list_(pa.int32())),
                pa.array([place], pa.int64()),
            ],
            names,
        )

    return number


def write_store(
    documents: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, part_documents: int = PART_DOCUMENTS
) -> None:
    """Writes the ids of all documents to a new store at ``path``, a folder that every executor reaches."""
    spark = documents.sparkSession
    vocabulary = vocabulary or default_path(VOCABULARY)
    encoder = loaded(LibraryEncoder, vocabulary)
    width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    encoded_path = f"{path}/encoded"
    _encoded(documents, vocabulary, end_id, width).write.option("compression", "zstd").partitionBy("kind").parquet(
        encoded_path
    )
    id_type = documents.schema["doc_id"].dataType.simpleString()
    encoded = spark.read.schema(
        f"doc_id {id_type}, n_tokens long, root binary, digests array<binary>, lengths array<int>, digest binary, "
        "data binary, kind string"
    ).parquet(encoded_path)
    chunks = encoded.filter(F.col("kind") == "chunk").select("digest", "data")
    chunks.groupBy("digest").agg(F.first("data").alias("data")).write.option("compression", "zstd").parquet(
        f"{path}/chunks"
    )
    recipes = encoded.filter(F.col("kind") == "document").select("doc_id", "n_tokens", "root", "digests", "lengths")
    parts = max(1, -(-recipes.count() // part_documents))
    recipes.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "root").sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "root"
    ).mapInArrow(
        _in_parts(),
        f"kind string, part int, place long, doc_id {id_type}, before long, n_tokens long, root binary, "
        "digests array<binary>, lengths array<int>, documents long",
    ).write.partitionBy("kind").parquet(f"{path}/recipes")
    delete_path(spark, encoded_path)
    roots = read_parts(spark, path).orderBy("part").collect()  # one row for each part of many documents
    spark.createDataFrame(
        [
            (
                FORMAT,
                width,
                id_type,
                sum(r["documents"] for r in roots),
                sum(r["n_tokens"] for r in roots),
                bytearray(merkle_root([bytes(r["root"]) for r in roots])),
            )
        ],
        "format int, width int, id_type string, documents long, n_tokens long, root binary",
    ).coalesce(1).write.parquet(f"{path}/manifest")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    schema = "part int, n_tokens long, root binary, documents long, kind string"
    return spark.read.schema(schema).parquet(f"{path}/recipes").filter(F.col("kind") == "part").drop("kind")


def _manifest(spark: SparkSession, path: str) -> tuple[dict, list[tuple[int, int]]]:
    """The manifest after a check against the parts, and (part, ids before it)."""
    found = spark.read.parquet(f"{path}/manifest").collect()
    if len(found) != 1 or found[0]["format"] != FORMAT:
        raise StoreError("no manifest of a known format")
    parts = read_parts(spark, path).orderBy("part").collect()
    if merkle_root([bytes(r["root"]) for r in parts]) != bytes(found[0]["root"]):
        raise StoreError("the parts differ from the manifest")
    starts, before = [], 0
    for r in parts:
        starts.append((r["part"], before))
        before += r["n_tokens"]
    return found[0].asDict(), starts


def _recipes(spark: SparkSession, path: str, id_type: str, checked: bool = False) -> DataFrame:
    """Recipes; if ``checked``, only of documents that have the root and the length that they say."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            digests, ends = batch.column(6).values.to_pylist(), batch.column(6).offsets.to_pylist()
            lengths, places = batch.column(7).values.to_numpy(), batch.column(7).offsets.to_numpy()
            totals = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))[places]
            if (np.diff(totals) != batch.column(4).to_numpy()).any() or any(
                merkle_root(digests[a:b]) != root
                for a, b, root in zip(ends[:-1], ends[1:], batch.column(5).to_pylist(), strict=True)
            ):
                raise StoreError("a document's recipe differs from its root")
            yield batch

    schema = (
        f"part int, place long, doc_id {id_type}, before long, n_tokens long, root binary, digests array<binary>, "
        "lengths array<int>"
    )
    rows = spark.read.schema(schema + ", kind string").parquet(f"{path}/recipes").filter(F.col("kind") == "document")
    rows = rows.drop("kind")
    return rows.mapInArrow(check, schema) if checked else rows


def verify_parts(spark: SparkSession, path: str) -> None:
    """Raises unless the documents' roots, in order, give the root of each part."""
    manifest, _ = _manifest(spark, path)

    def root(table):
        table = table.sort_by("place")
        return pa.table({"part": table["part"][:1], "made": pa.array([merkle_root(table["root"].to_pylist())], pa.binary())})

    made = (
        _recipes(spark, path, manifest["id_type"])
        .select("part", "place", "root")
        .groupBy("part")
        .applyInArrow(root, "part int, made binary")
    )
    wrong = read_parts(spark, path).filter("documents > 0").join(made, "part", "left").filter("made IS NULL OR made <> root")
    if not wrong.isEmpty():
        raise StoreError("the documents differ from a part's root")


def _checked_chunks(spark: SparkSession, path: str, width: int, with_data: bool) -> DataFrame:
    stored = np.dtype(f"<u{width}")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            crcs, counts = [], []
            for digest, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if hashlib.sha256(data).digest() != digest:
                    raise StoreError("a chunk differs from its digest")
                crcs.append(zlib.crc32(np.frombuffer(data, dtype=stored).astype("<u4").tobytes()))
                counts.append(len(data) // width)
            columns = [batch.column(0), pa.array(crcs, pa.int64()), pa.array(counts, pa.int64())]
            names = ["digest", "crc", "ids"]
            if with_data:
                columns.append(batch.column(1))
                names.append("data")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = spark.read.schema("digest binary, data binary").parquet(f"{path}/chunks")
    return rows.mapInArrow(check, "digest binary, crc long, ids long" + (", data binary" if with_data else ""))


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32 (reflected)."""
    product, bit = 0, 1 << 31
    while a:
        if a & bit:
            product ^= b
            a ^= bit
        bit >>= 1
        b = b >> 1 ^ 0xEDB88320 if b & 1 else b >> 1
    return product


_SHIFTS: dict[int, int] = {}


def crc32_joined(first: int, second: int, second_bytes: int) -> int:
    """The CRC-32 of two byte strings laid end to end, from those of each."""
    if second_bytes not in _SHIFTS:
        shift, square, n = 1 << 31, 1 << 30, 8 * second_bytes
        while n:
            if n & 1:
                shift = _times(shift, square)
            square = _times(square, square)
            n >>= 1
        _SHIFTS[second_bytes] = shift
    return _times(_SHIFTS[second_bytes], first) ^ second


def _joined(spark: SparkSession, path: str, manifest: dict, with_data: bool) -> DataFrame:
    """A row for each document with its chunks in order, read from the files."""
    chunks = _checked_chunks(spark, path, manifest["width"], with_data)
    wanted = _recipes(spark, path, manifest["id_type"], checked=True).select(
        "part", "place", F.posexplode("digests").alias("seq", "digest")
    )
    fields = ["seq", "crc", "ids"] + (["data"] if with_data else [])
    # a chunk that very many documents hold is one row of this side, and the other side can be split
    return (
        wanted.join(chunks.hint("merge"), "digest", "left")
        .groupBy("part", "place")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("pieces"))
    )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the store's files.

    Every chunk is read, checked and summed once; a document's checksum is put
    together from those of its chunks, so ids of a shared chunk don't travel to
    each document that holds it.
    """
    verify_parts(spark, path)
    manifest, starts = _manifest(spark, path)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            pieces, ends = batch.column(2).values, batch.column(2).offsets.to_numpy()
            crcs, sizes = pieces.field("crc"), pieces.field("ids")
            if crcs.null_count:
                raise StoreError("a chunk is missing")
            read = np.concatenate(([0], np.cumsum(sizes.to_numpy())))
            crcs, sizes, places, out = crcs.to_pylist(), sizes.to_pylist(), ends.tolist(), []
            for first, last in zip(places[:-1], places[1:], strict=True):
                crc = crcs[first] if first < last else 0
                for i in range(first + 1, last):
                    crc = crc32_joined(crc, crcs[i], 4 * sizes[i])
                out.append(crc)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.int64()), pa.array(np.diff(read[ends]))],
                ["part", "place", "ids_crc32", "read"],
            )

    summed = _joined(spark, path, manifest, False).mapInArrow(sums, "part int, place long, ids_crc32 long, read long")
    recipes = _recipes(spark, path, manifest["id_type"]).select("part", "place", "doc_id", "before", "n_tokens")
    offsets = spark.createDataFrame(starts, "part int, part_start long")
    same = F.when(F.col("read") == F.col("n_tokens"), F.col("ids_crc32"))
    return (
        recipes.join(summed, ["part", "place"], "left")
        .join(F.broadcast(offsets), "part")  # a row for each 50,000 documents
        .select(
            "doc_id",
            (F.col("part_start") + F.col("before")).alias("start"),
            "n_tokens",
            F.coalesce(same, F.raise_error(F.lit("a document's ids are not all there")).cast("long")).alias("ids_crc32"),
        )
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, ids`` (array of int) of every document, put together from the chunks."""
    manifest, _ = _manifest(spark, path)
    stored = np.dtype(f"<u{manifest['width']}")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [
                np.frombuffer(b"".join(p["data"] for p in pieces), dtype=stored).astype(np.int32)
                for pieces in batch.column(2).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["part", "place", "ids"]
            )

    built = _joined(spark, path, manifest, True).mapInArrow(build, "part int, place long, ids array<int>")
    recipes = _recipes(spark, path, manifest["id_type"]).select("part", "place", "doc_id")
    return recipes.join(built, ["part", "place"]).select("doc_id", "ids")


def store_and_read(documents: DataFrame, **options) -> DataFrame:
    """Writes a store in the shared folder and gives what its files hold."""
    spark = documents.sparkSession
    path = fresh_path(spark, "token-store")
    write_store(documents, path, **options)
    return read_digests(spark, path)
