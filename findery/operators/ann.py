"""Approximate nearest neighbours by inverted cells, always ranked by exact distances. Never the default.

Centroids are fitted to a bounded sample; every vector is indexed in the cell of
its nearest centroid. A query looks only into its ``probes`` nearest cells, so a
table stored by cell is read in part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findery.operators.vectors import QUERY_BLOCK, VECTOR_BLOCK, _best, check_vectors
from findery.schemas import HnswConfig

#: Rows that the centroids are fitted to, at most.
SAMPLE = 20_000


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Lloyd's algorithm from a seeded start."""
    r = np.random.default_rng(seed)
    centers = sample[r.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(sample, centers)[:, 0]
        for c in np.unique(own):
            centers[c] = sample[own == c].mean(axis=0)
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray, count: int = 1) -> np.ndarray:
    gaps = (x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)
    return np.argsort(gaps, axis=1, kind="stable")[:, :count]


class CellIndex:
    def __init__(self, rows: DataFrame, centers: np.ndarray, config: HnswConfig):
        self.rows, self.centers, self.config = rows, centers, config

    @staticmethod
    def build(vectors: DataFrame, config: HnswConfig, cells: int = 16) -> CellIndex:
        """``vectors(id, vector)``, already validated."""
        config.check()
        chosen = vectors.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vector").collect()  # bounded
        sample = np.array([r["vector"] for r in chosen], dtype=np.float64).reshape(len(chosen), config.dimensions)
        centers = fit_centroids(sample, cells) if len(sample) else np.zeros((1, config.dimensions))

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    x = np.stack(f["vector"].to_numpy()).astype(np.float64)
                    yield f.assign(cell=_nearest(x, centers)[:, 0])

        id_type = vectors.schema["id"].dataType.simpleString()
        rows = vectors.select("id", "vector").mapInPandas(place, f"id {id_type}, vector array<float>, cell int")
        return CellIndex(rows, centers, config)

    def query_batch(self, queries: DataFrame, k: int, probes: int = 12) -> DataFrame:
        """``query_id, rank, id, score`` from the ``probes`` cells nearest to each row of ``query_id, vector``.

        Vectors and queries of a cell are packed into blocks, and each pair of
        blocks is one row whose ``k`` best a task finds by a matrix product.
        """
        check_vectors(self.config, queries.select(F.col("query_id").alias("id"), "vector"))
        kind, centers = self.config.distance, self.centers
        id_type, query_type = self.rows.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

        def near(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            cells = _nearest(x, centers, probes)
            return np.repeat(np.arange(len(x)), cells.shape[1]), cells.ravel()

        asked = queries.select(F.col("query_id").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
        blocks = asked.mapInArrow(_by_cell(near, QUERY_BLOCK), f"cell int, query_ids array<{query_type}>, query_data binary")
        held = self.rows.select("id", "vector", "cell").mapInArrow(_by_cell(None, VECTOR_BLOCK), f"cell int, ids array<{id_type}>, data binary")
        # a cell's blocks meet the blocks of its queries
        pairs = held.join(blocks, "cell").select("ids", "data", "query_ids", "query_data")

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, names = batch.column("ids")[i].values, batch.column("query_ids")[i].values
                    x, q = (
                        np.frombuffer(batch.column(c)[i].as_py(), dtype=np.float32).astype(np.float64).reshape(len(own), -1)
                        for c, own in (("data", ids), ("query_data", names))
                    )
                    rows, cols, exact = _best(kind, x, q, k)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(cols)), ids.take(pa.array(rows)), pa.array(exact)], ["query_id", "id", "exact"])

        found = pairs.mapInArrow(best, f"query_id {query_type}, id {id_type}, exact double")
        order = Window.partitionBy("query_id").orderBy("score", "id")
        return (
            found.withColumn("score", F.col("exact").cast("float"))
            .withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score", "exact")
        )


def _by_cell(cells: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None, block: int) -> Callable:
    """Packs ``id, vector`` into blocks of one cell each, without a shuffle; ``cells`` gives rows and cells, else the third column does."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            rows, own = cells(x.astype(np.float64)) if cells else (np.arange(batch.num_rows), batch.column(2).to_numpy())
            for cell in np.unique(own):
                of = rows[own == cell]
                for first in range(0, len(of), block):
                    part = of[first : first + block]
                    ids = batch.column(0).take(pa.array(part))
                    held = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cell], pa.int32()), held, pa.array([x[part].tobytes()], pa.binary())], batch_names
                    )

    batch_names = ["cell", "query_ids", "query_data"] if cells else ["cell", "ids", "data"]
    return pack


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``query_id, recall`` of approximate hits against exact ones."""
    right = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return right.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
