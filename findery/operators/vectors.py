"""Vector index: validation, upserts, exact nearest neighbours for one query or a table of queries."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findery.errors import DimensionMismatch, DistanceNotRepresentable, InvalidVector
from findery.functions.distance import distance, not_finite
from findery.operators.bm25 import check_ids
from findery.schemas import HnswConfig, VectorDistance

#: Queries and vectors that are compared as blocks.
QUERY_BLOCK = 1024
VECTOR_BLOCK = 8192


def check_vector(config: HnswConfig, vector: Sequence[float]) -> None:
    """Configuration first, then length, then components."""
    config.check()
    if len(vector) != config.dimensions:
        raise DimensionMismatch(f"{len(vector)} components, not {config.dimensions}")
    if any(x is None or not math.isfinite(x) for x in vector):
        raise InvalidVector("a component isn't finite")


def check_vectors(config: HnswConfig, batch: DataFrame) -> None:
    """Refuses the first vector, by id, that has another length or a component that isn't finite."""
    config.check()
    size = F.coalesce(F.size("vector"), F.lit(-1))
    bad = batch.select("id", size.alias("size"), not_finite(F.col("vector")).alias("odd")).filter(
        (F.col("size") != config.dimensions) | F.coalesce("odd", F.lit(True))
    )
    wrong = bad.orderBy("id").first()
    if wrong is not None:
        if wrong["size"] != config.dimensions:
            raise DimensionMismatch(f"{wrong['id']}: {wrong['size']} components, not {config.dimensions}")
        raise InvalidVector(f"{wrong['id']}: a component isn't finite")


class VectorIndex:
    """``vectors(id, vector)``; immutable, every change gives another index. Search is exact."""

    def __init__(self, vectors: DataFrame, config: HnswConfig):
        self.vectors, self.config = vectors, config

    @staticmethod
    def empty(spark: SparkSession, config: HnswConfig, id_type: str = "bigint") -> VectorIndex:
        config.check()
        return VectorIndex(spark.createDataFrame([], f"id {id_type}, vector array<float>"), config)

    @staticmethod
    def build(vectors: DataFrame, config: HnswConfig, check: bool = True) -> VectorIndex:
        config.check()
        if check:
            check_ids(vectors)
            check_vectors(config, vectors)
        return VectorIndex(vectors.select("id", F.col("vector").cast("array<float>").alias("vector")), config)

    def insert(self, batch: DataFrame) -> VectorIndex:
        """Adds vectors; one with a known id replaces it."""
        added = VectorIndex.build(batch, self.config)
        left = self.vectors.join(batch.select("id").distinct(), "id", "left_anti")
        return VectorIndex(left.unionByName(added.vectors), self.config)

    def remove(self, ids: DataFrame) -> VectorIndex:
        return VectorIndex(self.vectors.join(ids.select("id").distinct(), "id", "left_anti"), self.config)

    def __len__(self) -> int:
        return self.vectors.count()

    def is_empty(self) -> bool:
        return self.vectors.isEmpty()

    def member_ids(self) -> DataFrame:
        return self.vectors.select("id").orderBy("id")

    def query(self, vector: Sequence[float], k: int, check: bool = True) -> DataFrame:
        """``rank, id, score`` of the ``k`` nearest: 32-bit distance ascending, then id.

        ``check`` looks at the distances of the best ``config.pool(k)`` first and
        refuses if one of them has no 32-bit value.
        """
        check_vector(self.config, vector)
        asked = F.array(*[F.lit(float(np.float32(x))).cast("float") for x in vector])
        exact = distance(self.config.distance, F.col("vector"), asked)
        scored = self.vectors.select("id", exact.alias("exact")).withColumn("score", F.col("exact").cast("float"))
        if k > 0 and check:
            pool = scored.orderBy("exact", "id").limit(self.config.pool(k))
            if not pool.filter(F.abs("score") == F.lit(float("inf")).cast("float")).isEmpty():
                raise DistanceNotRepresentable("a distance is beyond 32-bit floats")
        best = scored.orderBy("score", "id").limit(max(0, k))
        rank = F.row_number().over(Window.orderBy("score", "id"))
        return best.select(rank.alias("rank"), "id", "score", "exact")  # the window sees k rows

    def query_batch(self, queries: DataFrame, k: int, check: bool = True) -> DataFrame:
        """``query_id, rank, id, score`` for every row of ``query_id, vector``.

        Queries and vectors are packed into blocks, and each pair of blocks is one
        row whose ``k`` best a task finds by a matrix product; nothing is collected,
        and the shuffle carries ``k`` rows for a query and block. ``check`` refuses
        as ``query`` does.
        """
        asked = queries.select(F.col("query_id").alias("id"), "vector")
        check_vectors(self.config, asked)
        kind, pool = self.config.distance, self.config.pool(k)
        id_type, query_type = (df.schema["id"].dataType.simpleString() for df in (self.vectors, asked))
        blocks = _packed(asked, QUERY_BLOCK).withColumnsRenamed({"ids": "query_ids", "data": "query_data"})
        pairs = _packed(self.vectors, VECTOR_BLOCK).crossJoin(blocks)

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, names = batch.column("ids")[i].values, batch.column("query_ids")[i].values
                    x, q = (
                        np.frombuffer(batch.column(c)[i].as_py(), dtype=np.float32).astype(np.float64).reshape(len(held), -1)
                        for c, held in (("data", ids), ("query_data", names))
                    )
                    rows, cols, exact = _best(kind, x, q, k)
                    n = len(names)
                    # after the best, one row for a query that says how many distances fit 32 bits
                    fits = _fitting(kind, x, q) if check else np.full(n, len(ids))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.concat_arrays([names.take(pa.array(cols)), names]),
                            pa.concat_arrays([ids.take(pa.array(rows)), pa.nulls(n, ids.type)]),
                            pa.concat_arrays([pa.array(exact), pa.nulls(n, pa.float64())]),
                            pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array(fits, pa.int64())]),
                            pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array([len(ids)] * n, pa.int64())]),
                        ],
                        ["query_id", "id", "exact", "fits", "total"],
                    )

        found = pairs.mapInArrow(nearest, f"query_id {query_type}, id {id_type}, exact double, fits long, total long")
        whole = Window.partitionBy("query_id")
        order = whole.orderBy(F.col("total").isNotNull(), "score", "id")
        refused = F.raise_error(F.lit(f"{DistanceNotRepresentable.__name__}: a distance is beyond 32-bit floats")).cast("int")
        beyond = F.sum("fits").over(whole) < F.least(F.lit(pool), F.sum("total").over(whole))
        rank = F.row_number().over(order)
        return (
            found.withColumn("score", F.col("exact").cast("float"))
            .withColumn("rank", F.when(beyond, refused).otherwise(rank) if check and k > 0 else rank)
            .filter((F.col("rank") <= k) & F.col("total").isNull())
            .select("query_id", "rank", "id", "score", "exact")
        )


def _packed(vectors: DataFrame, block: int) -> DataFrame:
    """``ids, data``: blocks of vectors as 32-bit floats, without a shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, block):
                part = batch.slice(first, block)
                data = part.column(1).flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).tobytes()
                ids = part.column(0)
                held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays([ids]))
                yield pa.RecordBatch.from_arrays([held, pa.array([data], pa.binary())], ["ids", "data"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "vector").mapInArrow(pack, f"ids array<{kind}>, data binary")


def _best(kind: VectorDistance, x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, queries and exact distances of at least the ``k`` best of ``x`` for each row of ``q``, ties included."""
    rows, cols, exact = [], [], []
    if k < 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    near, slack = _approximate(kind, x, q)
    for j in range(len(q)):
        own = np.arange(len(x))
        if len(own) > k:
            most = np.partition(near[j], k - 1)[k - 1]
            # what rounding could bring among the best, and what 32 bits can't tell from them
            own = np.flatnonzero(near[j] <= most + 2 * slack[j] + abs(most) * 2.0**-22)
        d = _distances(kind, x[own], q[j : j + 1])[:, 0]
        if len(own) > k:
            score = d.astype(np.float32)
            kept = score <= np.partition(score, k - 1)[k - 1]
            own, d = own[kept], d[kept]
        rows.append(own)
        cols.append(np.full(len(own), j))
        exact.append(d)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(exact)


def _approximate(kind: VectorDistance, x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances by a matrix product, a row for each query, and a bound of their error."""
    if kind != VectorDistance.L2:
        d = _distances(kind, x, q).T
        return d, np.abs(np.where(np.isfinite(d), d, 0)).max(axis=1, initial=0) * 1e-12 + 1e-12
    xx, qq = (x * x).sum(axis=1), (q * q).sum(axis=1)
    return xx - 2 * (q @ x.T) + qq[:, None], (xx.max(initial=0) + qq) * 1e-12


def _fitting(kind: VectorDistance, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each query, how many distances come before the first that has no 32-bit value: all, or the finite ones."""
    scale = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] if len(x) else 0.0
    largest = max(scale, float((x * x).sum(axis=1).max(initial=0)) * 2 + float((q * q).sum(axis=1).max(initial=0)) * 2)
    if kind == VectorDistance.COSINE or largest < 1e38:
        return np.full(len(q), len(x))
    with np.errstate(over="ignore"):
        scores = _distances(kind, x, q).astype(np.float32)
    finite = np.isfinite(scores).sum(axis=0)
    return np.where((scores == -np.inf).any(axis=0), -(1 << 40), finite)


def _distances(kind: VectorDistance, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    if kind == VectorDistance.L2:
        return np.stack([((x - v) ** 2).sum(axis=1) for v in q], axis=1)
    dots = x @ q.T
    if kind == VectorDistance.INNER_PRODUCT:
        return -dots
    nx, nq = np.sqrt((x * x).sum(axis=1))[:, None], np.sqrt((q * q).sum(axis=1))[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 1 - dots / (nx * nq)
    return np.where((nx == 0) & (nq == 0), 0.0, np.where((nx == 0) | (nq == 0), 1.0, out))
